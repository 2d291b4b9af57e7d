"""The text pass: what is asked about a message, whether the gate lets it through, and what the answers say."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilake.functions import scores, text
from vigilake.operators.settings import TOPICS

MIN_CHARS, GATE_QUESTIONS, GATE_BAR, CHOICE_BAR = 8, 3, 0.3, 0.6


def questions(text_scan: Column, topics: Column, ad_scan: Column) -> Column:
    """ML12: how many questions a group's settings ask: its topics, and whether it is an advert."""
    return F.when(text_scan, F.size(topics)).otherwise(0) + ad_scan.cast("int")


def route(words: Column, asked: Column, gate: Column) -> Column:
    """ML11, ML12, D1: short texts and groups that ask nothing are left; of three questions or more, the gate drops what it
    finds ordinary; an unknown answer of the gate opens the full pass."""
    short = F.char_length(text.trim_space(words)) < MIN_CHARS
    return F.when(asked == 0, "nothing").when(short, "short").when((asked >= GATE_QUESTIONS) & F.coalesce(gate < GATE_BAR, F.lit(False)), "ordinary").otherwise("full")


def ranked(answers: Column) -> Column:
    """SO05: answers (id, certainty) by certainty, largest first, then by id; unknown ones left out."""
    known = F.filter(answers, lambda a: a["certainty"].isNotNull())
    keyed = F.array_sort(F.transform(known, lambda a: F.struct((-a["certainty"]).alias("k"), a["id"].alias("id"), a["certainty"].alias("certainty"))))
    return F.transform(keyed, lambda a: F.struct(a["id"].alias("id"), a["certainty"].alias("certainty")))


def strongest_topic(answers: Column, text_scan: Column, bar: Column) -> Column:
    """SG11: the topic of most certainty, if it reaches the bar; an advert is no topic."""
    over = F.filter(ranked(answers), lambda a: (a["certainty"] >= bar) & a["id"].isin(*TOPICS))
    return F.when(text_scan, F.try_element_at(over, F.lit(1)))


def advertising(answers: Column, ad_scan: Column, bar: Column) -> Column:
    """SG12: certainty of being an advert, if asked and at the bar."""
    mine = F.try_element_at(F.filter(answers, lambda a: a["id"] == "is_advertising"), F.lit(1))["certainty"]
    return F.when(ad_scan & (mine >= bar), mine)


def topic_detail(topic: Column) -> Column:
    """SG11: the topic's own name and percent, in no language."""
    return F.concat(topic["id"], F.lit(" "), scores.percent(topic["certainty"]).cast("string"), F.lit("%"))


def chosen(choice: Column, confidence: Column) -> Column:
    """a choice counts from a confidence of 0.6; a missing confidence is none."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) >= CHOICE_BAR, choice)


def group_language(model: Column, title: Column) -> Column:
    """ML15: the model's confident answer, else the script of the title."""
    return F.coalesce(model, text.detect_language(title))


def substantive(bio: Column, avatar_text: Column, channel_state: Column) -> Column:
    """F22, ML14: whether a profile holds anything to judge."""
    return F.coalesce(
        (F.char_length(text.trim_space(bio)) >= 3) | F.coalesce(text.trim_space(avatar_text) != "", F.lit(False)) | (channel_state == "linked"),
        F.coalesce(text.trim_space(avatar_text) != "", F.lit(False)) | (channel_state == "linked"),
    )


def profile_state(name: Column, username: Column, bio: Column, channel_state: Column, channel_title: Column, channel_username: Column, avatar_text: Column) -> Column:
    """a profile as labelled JSON; an absent channel is null, one not looked up says so."""
    quoted = lambda c: F.coalesce(F.to_json(F.array(text.clip(c))), F.lit("[null]"))
    bare = lambda c: F.substring(quoted(c), 2, 1_000_000_000).substr(F.lit(1), F.length(quoted(c)) - 2)
    channel = F.when(
        channel_state == "linked", F.concat(F.lit('{"title":'), bare(channel_title), F.lit(',"username":'), bare(channel_username), F.lit("}"))
    ).when(channel_state == "absent", "null").otherwise('"not looked up"')
    return F.concat(
        F.lit('{"telegram_profile":{"display_name":'), bare(name), F.lit(',"username":'), bare(username), F.lit(',"bio":'), bare(bio),
        F.lit(',"attached_channel":'), channel, F.lit(',"text_on_avatar":'), bare(avatar_text), F.lit("}}"),
    )
