"""AG01, AG04, F39: rolling counters kept as day rollups that merge: a new day reads its own rows, a report reads rollups and three days of rows at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.operators.stats import WINDOWS

FLAGS = {"detected": "true", "deleted": "deleted", "banned": "banned"}
_DAY = "to_date(created_at)"


def by_day(detections: DataFrame) -> DataFrame:
    """Counts of each chat and day."""
    return detections.groupBy("chat_id", F.expr(_DAY).alias("day")).agg(*[F.count_if(F.expr(f)).alias(n) for n, f in FLAGS.items()])


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rollups of two disjoint sets of rows, whatever days they share."""
    both = old.unionByName(new)
    return both.groupBy("chat_id", "day").agg(*[F.sum(n).alias(n) for n in FLAGS])


def _start(as_of: str, days: int) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAYS")


def _parts(rollup: DataFrame, detections: DataFrame, as_of: str) -> DataFrame:
    """Rows of counts with, for each window, whether they count: whole days behind a window's first day, and single rows of the first days."""
    spans = {w: n for w, n in WINDOWS.items() if n is not None}
    starts = {w: _start(as_of, n) for w, n in spans.items()}
    whole = {w: F.lit(True) if w not in starts else F.col("day") > F.to_date(starts[w]) for w in WINDOWS}
    first = F.lit(False)
    for s in starts.values():
        day = F.date_trunc("DAY", s).cast("timestamp_ntz")
        first = first | ((F.col("created_at") >= day) & (F.col("created_at") < day + F.expr("INTERVAL 1 DAY")))
    rows = detections.filter(first).withColumns({"day": F.expr(_DAY), **{n: F.expr(f).cast("int").cast("long") for n, f in FLAGS.items() if n != "detected"}, "detected": F.lit(1).cast("long")})
    single = {w: F.lit(False) if w not in starts else (F.col("day") == F.to_date(starts[w])) & (F.col("created_at") >= starts[w]) for w in WINDOWS}
    pick = lambda df, inside: df.select("chat_id", *FLAGS, *[c.alias(f"in_{w}") for w, c in inside.items()])
    return pick(rollup, whole).unionByName(pick(rows, single))


def _sums(names) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col(f"in_{w}"), F.col(n))), F.lit(0)).cast("long").alias(f"{n}_{w}") for w in WINDOWS for n in names]


def by_group(rollup: DataFrame, detections: DataFrame, as_of: str) -> DataFrame:
    """AG01: as ``stats.by_group`` over all rows; ``detections`` is read for the first day of each window only."""
    return _parts(rollup, detections, as_of).groupBy("chat_id").agg(*_sums(FLAGS))


def overall(rollup: DataFrame, detections: DataFrame, as_of: str) -> DataFrame:
    """AG04: as ``stats.overall``."""
    return _parts(rollup, detections, as_of).agg(*_sums(["detected", "banned"]))
