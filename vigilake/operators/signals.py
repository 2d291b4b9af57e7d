"""Signals: ``signal(id)`` builds a struct <triggered, score, detail, available> from context columns.

A signal that can't be evaluated is neither clean nor a match: ``triggered`` is never null and
``available`` tells whether the inputs were there. Policies read ``triggered`` only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions import scores, text

REGISTRY: dict[str, tuple[frozenset[str], Callable[[], Column]]] = {}
SEMANTIC_BAR = 0.7


def signal(name: str, needs: str = ""):
    """Register a column builder and the inputs that it needs."""

    def put(build):
        REGISTRY[name] = (frozenset(needs.split()), build)
        return build

    return put


def outcome(triggered: Column, score: Column, detail: Column, available: Column | None = None, keep_score: bool = False) -> Column:
    """Score clamped to [0, 1] when triggered; otherwise 0, or as it was with ``keep_score``."""
    hit = F.coalesce(triggered, F.lit(False))
    clamped = scores.clamp_certainty(score.cast("double"))
    return F.struct(
        hit.alias("triggered"),
        F.coalesce(F.when(hit | F.lit(keep_score), clamped), F.lit(0.0)).alias("score"),
        F.when(hit | F.lit(keep_score), detail).alias("detail"),
        (F.lit(True) if available is None else F.coalesce(available, F.lit(False))).alias("available"),
    )


def _scored(column: str) -> Column:
    s = F.col(column)
    detail = F.concat(scores.percent(s).cast("string"), F.lit("%"))
    return outcome(s.cast("float") >= scores.ratio(F.col("threshold")), s, detail, s.isNotNull(), keep_score=True)


def _contact(column: str, most: int, also: Column | None = None) -> Column:
    found = text.contacts(F.col(column))
    hit = text.has_contact(found) if also is None else text.has_contact(found) & also
    return outcome(hit, F.lit(1.0), text.contact_summary(found, most), F.col(column).isNotNull())


@signal("profile_nsfw", "photos")
def profile_nsfw() -> Column:
    return _scored("profile_nsfw")


@signal("message_media", "media")
def message_media() -> Column:
    return _scored("message_nsfw")


@signal("bio_link", "bio")
def bio_link() -> Column:
    return _contact("bio", 3)


@signal("profile_channel", "channel")
def profile_channel() -> Column:
    state = F.col("channel_state")
    label = text.channel_label(F.col("channel_username"), F.col("channel_title"))
    return outcome(state == "linked", F.lit(1.0), text.escape_html(text.truncate(label, 40)), state != "unknown")


@signal("bio_keywords", "bio")
def bio_keywords() -> Column:
    found = text.keywords(F.concat_ws(" ", "display_name", "username", "bio"))
    return outcome(F.size(found) > 0, F.lit(1.0), text.escape_html(F.array_join(found, ", ")))


@signal("bio_semantic", "bio channel ad_score")
def bio_semantic() -> Column:
    s = F.col("profile_ad")
    return outcome(s.cast("float") >= F.lit(SEMANTIC_BAR).cast("float"), s, F.concat(scores.percent(s).cast("string"), F.lit("%")), s.isNotNull())


@signal("name_pattern")
def name_pattern() -> Column:
    hits = text.name_hits(F.col("display_name"))
    return outcome(F.size(hits) > 0, F.when(F.size(hits) >= 2, 1.0).otherwise(0.6), text.escape_html(F.array_join(hits, ", ")))


@signal("profile_ocr", "photos ocr")
def profile_ocr() -> Column:
    return _contact("avatar_text", 2)


@signal("no_photo_link", "photos bio")
def no_photo_link() -> Column:
    return _contact("bio", 2, F.col("photos") == "absent")


@signal("reputation", "bans")
def reputation() -> Column:
    n = F.col("other_group_bans")
    on = F.col("global_blocklist") & n.isNotNull()
    return outcome(on & (n >= F.col("reputation_min_bans")), F.lit(1.0), n.cast("string"), on)


def needs_of(ids) -> frozenset[str]:
    """AG11, O1: the inputs that a set of signals needs; scoring stages nobody needs stay out of the plan."""
    return frozenset().union(*(REGISTRY[i][0] for i in ids if i in REGISTRY))


def with_signals(contexts: DataFrame) -> DataFrame:
    """All registered signals as one struct column ``signals``."""
    return contexts.withColumn("signals", F.struct(*[build().alias(name) for name, (_, build) in REGISTRY.items()]))


def triggered_ids(signals: str = "signals") -> Column:
    """SO03: sorted ids of what triggered."""
    hits = [F.when(F.col(f"{signals}.{name}.triggered"), F.lit(name)) for name in sorted(REGISTRY)]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())
