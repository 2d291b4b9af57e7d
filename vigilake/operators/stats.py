"""Reports: nested rolling windows in one pass, reach, top groups, notification targets, threshold sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigilake.functions import scores

WINDOWS = {"d1": 1, "d7": 7, "d30": 30, "all": None}


def _counts(as_of: str, flags: dict[str, str]):
    for w, days in WINDOWS.items():
        inside = F.lit(True) if days is None else F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAYS")
        for name, flag in flags.items():
            yield F.count_if(inside & F.expr(flag)).alias(f"{name}_{w}")


def by_group(detections: DataFrame, as_of: str) -> DataFrame:
    """AG01: twelve conditional counts for each chat."""
    flags = {"detected": "true", "deleted": "deleted", "banned": "banned"}
    return detections.groupBy("chat_id").agg(*_counts(as_of, flags))


def overall(detections: DataFrame, as_of: str) -> DataFrame:
    """AG04."""
    return detections.agg(*_counts(as_of, {"detected": "true", "banned": "banned"}))


def public_totals(detections: DataFrame, groups: DataFrame) -> DataFrame:
    """AG02: one row from two one-row aggregates."""
    d = detections.agg(F.count(F.lit(1)).alias("detections"), F.expr("count_if(banned)").alias("banned"))
    return d.crossJoin(groups.agg(F.expr("count_if(is_active)").alias("active_groups")))


def reach(users: DataFrame, groups: DataFrame) -> DataFrame:
    """AG03."""
    u = users.agg(F.expr("count_if(started_bot)").alias("started"), F.expr("count_if(started_bot AND NOT is_blocked)").alias("reachable"))
    g = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.expr("count_if(is_active)").alias("active_groups"),
        F.expr("coalesce(sum(member_count) FILTER (WHERE is_active), 0)").alias("members"),
    )
    return u.crossJoin(g)


def top_groups(groups: DataFrame, detections: DataFrame, as_of: str, k: int = 5, days: int = 30) -> DataFrame:
    """J01, AG06, SO01: counted before the join; ties by chat."""
    recent = detections.filter(F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAYS"))
    hits = recent.groupBy("chat_id").agg(F.count(F.lit(1)).alias("hits"))
    named = hits.join(groups.select("chat_id", "title"), "chat_id")
    return named.select("chat_id", F.coalesce("title", F.col("chat_id").cast("string")).alias("title"), "hits").orderBy(F.desc("hits"), "chat_id").limit(k)


def notify_targets(prefs: DataFrame, users: DataFrame) -> DataFrame:
    """Admins who asked for notices and can be reached."""
    open_ = users.filter("started_bot AND NOT is_blocked")
    return prefs.filter("dm_notify").join(open_, prefs.admin_id == open_.user_id).select("chat_id", "admin_id")


def recipients(users: DataFrame, groups: DataFrame, rate: int = 25) -> DataFrame:
    """SE01, SO02, ST10: users, then groups, in order; each at its second of a paced delivery."""
    both = users.filter("started_bot AND NOT is_blocked").select(F.lit(0).alias("part"), F.col("user_id").alias("target")).unionByName(
        groups.filter("is_active").select(F.lit(1).alias("part"), F.col("chat_id").alias("target"))
    )
    # ranks inside buckets of 65,536 ids, shifted by the rows of the buckets before: no task gets all rows, and there are few buckets
    both = both.withColumn("bucket", F.floor(F.col("target") / 65536))
    sizes = both.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    users_n = sizes.agg(F.coalesce(F.expr("sum(n) FILTER (WHERE part = 0)"), F.lit(0)).alias("users_n"))
    ranked = both.withColumn("rn", F.row_number().over(Window.partitionBy("part", "bucket").orderBy("target")))
    placed = ranked.join(before.drop("n"), ["part", "bucket"]).crossJoin(F.broadcast(users_n))
    seq = F.col("rn") + F.coalesce("before", F.lit(0)) + F.when(F.col("part") == 1, F.col("users_n")).otherwise(0)
    return placed.select("part", "target", seq.cast("long").alias("seq"), F.floor((seq - 1) / rate).cast("long").alias("second"))


def threshold_sweep(scored: DataFrame, first: int = 10, last: int = 95, step: int = 5) -> DataFrame:
    """AG16: confusion counts by threshold from (score, positive); ``best`` marks the first of most accuracy.

    Rows are counted by score bucket once (at most as many rows as thresholds); thresholds are summed over those.
    """
    count = (last - first) // step + 1
    bucket = F.greatest(F.lit(-1), F.least(F.lit(count - 1), F.floor((F.round(F.col("score") * 100, 9) - first) / step)))
    sizes = scored.groupBy(bucket.cast("int").alias("bucket"), "positive").agg(F.count(F.lit(1)).alias("n"))
    marks = scored.sparkSession.range(count).select(F.col("id").cast("int").alias("i"), (F.col("id") * step + first).cast("int").alias("threshold"))
    hit = "bucket >= i"
    out = marks.crossJoin(F.broadcast(sizes)).groupBy("threshold").agg(
        *[
            F.coalesce(F.expr(f"sum(n) FILTER (WHERE {cond})"), F.lit(0)).cast("long").alias(name)
            for name, cond in {"tp": f"positive AND {hit}", "fp": f"NOT positive AND {hit}", "fn": f"positive AND NOT {hit}", "tn": f"NOT positive AND NOT {hit}"}.items()
        ]
    )
    out = out.withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6))
    best = F.row_number().over(Window.orderBy(F.desc("accuracy"), "threshold")) == 1  # as many rows as thresholds
    return out.withColumn("best", best)


def evaluated_by_both(screened: DataFrame, verified: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """SE05, SO08: what both evaluations hold: screening score, category score, and the two labels of most weight."""
    best = scores.sorted_labels(F.col("labels"))
    total = scores.category_score(F.col("labels"), F.array(*map(F.lit, categories)))
    name = lambda k: F.try_element_at(best, F.lit(k))["label"]
    return screened.join(verified, key).select(key, "fast", total.alias("score"), name(1).alias("first"), name(2).alias("second"))
