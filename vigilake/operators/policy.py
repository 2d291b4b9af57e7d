"""Policies: which combinations of triggered signals match, and what is done about it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severities, and the signals that each policy consults besides reputation.
SEVERITY = {"report": 0, "warn": 1, "delete": 2, "mute": 3, "ban": 4}
IMAGE = ["profile_nsfw", "message_media"]
CONTACT = ["bio_link", "profile_channel", "profile_ocr"]
VOCABULARY = ["bio_keywords", "bio_semantic", "name_pattern"]
CONSULTED = {
    "nsfw_only": IMAGE,
    "nsfw_and_contact": IMAGE + CONTACT,
    "nsfw_or_keywords": IMAGE + VOCABULARY,
    "strict": IMAGE + CONTACT + VOCABULARY,
}


def _any(triggered: Column, ids: list[str]) -> Column:
    return F.arrays_overlap(triggered, F.array(*map(F.lit, ids)))


def matched(triggered: Column, policy: Column, custom: Column) -> Column:
    """PL01-PL07 from the array of triggered ids."""
    image, contact, words = (_any(triggered, ids) for ids in (IMAGE, CONTACT, VOCABULARY))
    votes = image.cast("int") + contact.cast("int") + words.cast("int")
    by_policy = (
        F.when(policy == "nsfw_only", image)
        .when(policy == "nsfw_and_contact", image & contact)
        .when(policy == "nsfw_or_keywords", image | words)
        .when(policy == "strict", votes >= 2)
        .when(policy == "custom", (F.size(custom) > 0) & F.forall(custom, lambda f: F.array_contains(triggered, f)))
    )
    return F.array_contains(triggered, "reputation") | F.coalesce(by_policy, F.lit(False))


def consulted(policy: Column, custom: Column) -> Column:
    """Ids that a policy reads; reputation always among them."""
    ids = F.create_map(*[x for k, v in CONSULTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.when(policy == "custom", custom).otherwise(F.coalesce(F.try_element_at(ids, policy), F.array().cast("array<string>")))
    return F.array_append(own, F.lit("reputation"))


def verdict(triggered: Column, score: Column, policy: Column, action: Column, custom: Column, dry_run: Column) -> Column:
    """PL08-PL10: struct <matched, action, score, reasons>; what doesn't match is a clean report."""
    hit = matched(triggered, policy, custom)
    reasons = F.array_sort(F.filter(triggered, lambda x: F.array_contains(consulted(policy, custom), x)))
    return F.struct(
        hit.alias("matched"),
        F.when(hit & ~dry_run, action).otherwise("report").alias("action"),
        F.when(hit, score).otherwise(0.0).alias("score"),
        F.when(hit, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )


def headline_score(profile: Column, media: Column) -> Column:
    """AG12: the larger image score, triggered or not."""
    return F.greatest(F.coalesce(profile, F.lit(0.0)), F.coalesce(media, F.lit(0.0)))


def strongest(*actions: Column) -> Column:
    """AG14: the action of most severity; nulls don't count, nothing at all is a report."""
    codes = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    names = F.array(*map(F.lit, SEVERITY))
    return F.element_at(names, F.greatest(F.lit(0), *[F.coalesce(F.try_element_at(codes, a), F.lit(0)) for a in actions]) + 1)


def text_verdict(topic: Column, topic_score: Column, ad_score: Column, text_action: Column, ad_action: Column, dry_run: Column) -> Column:
    """PL11: what the words of a message say; one verdict with all reasons at the stronger action."""
    on_topic, is_ad = topic.isNotNull(), ad_score.isNotNull()
    reasons = F.filter(F.array(F.when(on_topic, F.lit("text_topic")), F.when(is_ad, F.lit("text_ad"))), lambda x: x.isNotNull())
    action = strongest(F.when(on_topic, text_action), F.when(is_ad, ad_action))
    return F.struct(
        (on_topic | is_ad).alias("matched"),
        F.when(dry_run, "report").otherwise(action).alias("action"),
        F.greatest(F.coalesce(F.when(on_topic, topic_score), F.lit(0.0)), F.coalesce(ad_score, F.lit(0.0))).alias("score"),
        reasons.alias("reasons"),
    )


def media_verdict(score: Column, threshold: Column, action: Column, dry_run: Column) -> Column:
    """PL12: a medium at or over its own threshold."""
    hit = F.coalesce(score >= threshold, F.lit(False))
    return F.struct(
        hit.alias("matched"),
        F.when(hit & ~dry_run, action).otherwise("report").alias("action"),
        F.when(hit, score).otherwise(0.0).alias("score"),
        F.when(hit, F.array(F.lit("message_media"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )


def first_match(*verdicts: Column) -> Column:
    """PL13: the first verdict that matches, else the last."""
    out = verdicts[-1]
    for v in reversed(verdicts[:-1]):
        out = F.when(v["matched"], v).otherwise(out)
    return out


def reaction_verdict(triggered: Column, profile: Column, policy: Column, action: Column, custom: Column, dry_run: Column) -> Column:
    """PL14: a reaction is judged by its author's profile alone; the only message in sight is another's, so none is named."""
    own = F.filter(triggered, lambda x: x != "message_media")
    v = verdict(own, headline_score(profile, F.lit(None).cast("double")), policy, action, custom, dry_run)
    return v.withField("message_id", F.lit(None).cast("long"))
