"""Scores as column expressions: percent, thresholds, softmax, category sums, answers, frames."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percent(c: Column) -> Column:
    """clamped to [0, 1], in whole percent, half away from zero."""
    return F.round(clamp_certainty(c.cast("double")) * 100).cast("int")


def ratio(threshold: Column) -> Column:
    """a threshold of 0 to 100 as FLOAT, so that FLOAT scores compare exactly."""
    kept = F.when(threshold.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), threshold)))
    return (kept.cast("float") / 100).cast("float")


def softmax(values: Column) -> Column:
    """stable softmax of an array."""
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def category_score(labels: Column, categories: Column) -> Column:
    """AG09, AG10: sum of the labels' values in ``categories``, case ignored; none: 0."""
    wanted = F.transform(categories, lambda c: F.lower(c))
    hits = F.filter(labels, lambda x: F.array_contains(wanted, F.lower(x["label"])))
    return F.aggregate(hits, F.lit(0.0), lambda a, x: a + x["value"])


def sorted_labels(labels: Column) -> Column:
    """SO04: by value, largest first, then by name."""
    keyed = F.array_sort(F.transform(labels, lambda x: F.struct((-x["value"]).alias("k"), x["label"].alias("label"), x["value"].alias("value"))))
    return F.transform(keyed, lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value")))


def certainty(noul: Column, score: Column, legend_size: Column, levels: Column) -> Column:
    """F32: a direct answer, else its level out of the levels but one; a legend counts before the levels sent."""
    n = F.coalesce(legend_size, levels)
    scaled = F.when(n > 1, score / (n - 1))
    return clamp_certainty(F.coalesce(noul, scaled))


def clamp_certainty(c: Column) -> Column:
    """A missing answer stays missing (``greatest`` and ``least`` skip nulls)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def frame_indexes(total: Column, most: Column) -> Column:
    """frames spread over a clip, both ends included, halves to even."""
    even = F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))), lambda i: F.bround(i * (total - 1) / F.greatest(most - 1, F.lit(1))).cast("int"))
    )
    return (
        F.when((total <= 1) | (most <= 1), F.array(F.lit(0)))
        .when(total <= most, F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0))))
        .otherwise(even)
    )


def frame_rate(most: Column, duration: Column) -> Column:
    """frames a second that give ``most`` over the clip; 1 without a duration."""
    return F.when(duration > 0, F.greatest(F.lit(0.01), F.least(F.lit(30.0), most / duration))).otherwise(F.lit(1.0))


def container(content: Column) -> Column:
    """kind of a clip by its first bytes."""
    return F.when(F.substring(content, 5, 4) == F.lit(b"ftyp"), "mp4").when(F.substring(content, 1, 4) == F.lit(b"\x1a\x45\xdf\xa3"), "matroska")
