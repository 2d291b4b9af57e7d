"""Registered queries of the streams; each gives the rows of a table's query over the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.operators.state import micros
from vigilake.plans.queries import _NUMBERED, ORACLES, scratch
from vigilake.plans.registry import query
from vigilake.sources import bindings as b
from vigilake.streaming import keyed

DAY = 86_400


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events of a file as a stream of detections, with their time in microseconds."""
    return b.detection_rows(keyed.file_stream(spark, f"{sf}/events.parquet")).withColumns({"event_id": F.col("id"), "ts_us": micros("created_at")})


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of settings that void what is remembered of a chat."""
    return b.detections(spark, sf).filter("event_type = 'signup' AND id % 4 = 0").select("chat_id", micros("created_at").alias("changed_us"))


@query(_NUMBERED.replace("SELECT id,", "SELECT id AS event_id,"), "detections")
def stream_message_counts(spark, sf):
    """ST01: the same rows as message_number."""
    return keyed.replayed(spark, _events(spark, sf), keyed.message_counts(), scratch(spark, "counts"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE allowed) AS allowed FROM (" + ORACLES["rate_limit_fold"] + ") GROUP BY user_id")
def stream_rate_limit(spark, sf):
    """ST05: as many allowed as in rate_limit_fold."""
    rows = keyed.replayed(spark, _events(spark, sf), keyed.rate_limit(2, DAY // 2), scratch(spark, "limits"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(allowed)").alias("allowed"))


@query(
    ORACLES["rate_limit_fold"].replace("SELECT user_id, t AS ts_us, n, allowed FROM r", "SELECT user_id, t AS ts_us, hits[1] + 43200000000 - t AS retry_after_us FROM r WHERE NOT allowed").replace(
        "CASE WHEN len(live) < 2 THEN list_append(live, t.t) ELSE live END", "CASE WHEN len(live) < 2 THEN list_append(live, t.t) ELSE live END AS hits"
    )
)
def stream_retry_after(spark, sf):
    """ST05: what a rejected attempt is told, from the oldest attempt kept."""
    times = b.detections(spark, sf).select(F.col("id").alias("event_id"), micros("created_at").alias("ts_us"))
    rows = keyed.replayed(spark, _events(spark, sf), keyed.rate_limit(2, DAY // 2), scratch(spark, "retries")).filter("NOT allowed")
    return rows.join(times, "event_id").select("user_id", "ts_us", "retry_after_us")


@query(ORACLES["clean_fold_voided"])
def stream_clean_scans(spark, sf):
    """ST02, P16: the rows of clean_fold_voided, with the changes as a table that the stream is joined with."""
    rows = _events(spark, sf).filter("NOT (event_type = 'signup' AND id % 4 = 0)").withColumn("clean", F.expr("event_type <> 'error'"))
    arranged = lambda d: keyed.last_change(d, _changes(spark, sf), "chat_id")
    out = keyed.replayed(spark, rows, keyed.clean_interval(DAY // 2, ["chat_id"]), scratch(spark, "clean"), arranged=arranged)
    return out.select("chat_id", "ts_us", "clean")


@query(ORACLES["media_cache_fold"])
def stream_media_cache(spark, sf):
    """ST03: the rows of media_cache_fold."""
    rows = _events(spark, sf).withColumns({
        "bar": F.lit(0.3), "fast": F.expr("IF(id % 5 <> 0, floor(score * 100) / 100, NULL)"), "verified": F.expr("id % 3 = 0"), "changed_us": F.lit(None).cast("long"),
    })
    out = keyed.replayed(spark, rows, keyed.cached_answers(3 * DAY, ["user_id"]), scratch(spark, "media"))
    return out.select("user_id", "ts_us", "source", F.round("score", 6).alias("score"))


def _voided_cache(keys: str, fast: str, seconds: int) -> str:
    """SQL of a cache that the changes of a chat void: entries answer whatever the bar."""
    on = " AND ".join(f"e.{k} = r.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE detections AS ({b.SQL['detections']}), v AS (SELECT chat_id, epoch_us(created_at) AS t FROM detections WHERE event_type = 'signup' AND id % 4 = 0),
    e AS (SELECT {keys}, d.id, epoch_us(created_at) AS t, {fast} AS fast, (SELECT max(v.t) FROM v WHERE v.chat_id = d.chat_id AND v.t <= epoch_us(created_at)) AS changed, row_number() OVER (PARTITION BY {keys} ORDER BY created_at, id) AS n
      FROM (SELECT *, 'text ' || user_id % 40 AS text_key FROM detections) d),
    r AS (SELECT {keys}, id, n, t, false AS hit, fast AS score, CASE WHEN fast IS NOT NULL THEN t END AS kt, fast AS kf FROM e WHERE n = 1
      UNION ALL SELECT {keys}, id, n, t, hit, CASE WHEN hit THEN kf ELSE fast END, CASE WHEN hit THEN kt WHEN fast IS NOT NULL THEN t WHEN dead THEN NULL ELSE kt END, CASE WHEN NOT hit AND fast IS NOT NULL THEN fast ELSE kf END
      FROM (SELECT e.*, kt, kf, coalesce(kt IS NULL OR e.changed > kt OR e.t - kt >= {seconds}000000, false) AS dead, coalesce(NOT e.changed > kt, true) AND coalesce(e.t - kt < {seconds}000000, false) AS hit FROM r JOIN e ON {on} AND e.n = r.n + 1))
    SELECT id, {keys}, CASE WHEN hit THEN 'cache' ELSE 'scored' END AS source, round(score, 6) AS score FROM r"""


@query(_voided_cache("chat_id, text_key", "CASE WHEN d.id % 5 <> 0 THEN floor(score * 100) / 100 END", 6 * 3600 * 12))
def stream_text_verdicts(spark, sf):
    """ST04: verdicts of a chat's texts, voided by the chat's changes; only real answers are stored. Three days to live, so that some are met again."""
    rows = _events(spark, sf).withColumns({
        "text_key": F.expr("'text ' || user_id % 40"), "bar": F.lit(float("inf")), "fast": F.expr("IF(id % 5 <> 0, floor(score * 100) / 100, NULL)"), "verified": F.lit(True),
    })
    arranged = lambda d: keyed.last_change(d, _changes(spark, sf), "chat_id")
    fold = keyed.cached_answers(3 * DAY, ["chat_id", "text_key"], {"text_key": "string"})
    out = keyed.replayed(spark, rows, fold, scratch(spark, "texts"), arranged=arranged)
    return out.select(F.col("event_id").alias("id"), "chat_id", "text_key", "source", F.round("score", 6).alias("score"))


@query(_voided_cache("chat_id", "CAST(d.id AS DOUBLE)", 3600))
def stream_admin_snapshots(spark, sf):
    """ST06: who a chat's admins are is asked again after a time or a change of membership; the score is the number of the snapshot that answers."""
    rows = _events(spark, sf).withColumns({"bar": F.lit(float("inf")), "fast": F.col("id").cast("double"), "verified": F.lit(True)})
    arranged = lambda d: keyed.last_change(d, _changes(spark, sf), "chat_id")
    out = keyed.replayed(spark, rows, keyed.cached_answers(3600, ["chat_id"]), scratch(spark, "admins"), arranged=arranged)
    return out.select(F.col("event_id").alias("id"), "chat_id", "source", F.round("score", 6).alias("score"))


@query("SELECT id, created_at + to_seconds(greatest(5, least(86400, id % 100000))) AS delete_at FROM detections", "detections")
def stream_self_delete(spark, sf):
    """SNK08, ST12: the times of self_delete_at, each given by the timer of its message."""
    rows = _events(spark, sf).select(F.col("id").alias("message_id"), "event_id", "ts_us", F.expr("id % 100000").alias("ttl"))
    out = keyed.replayed(spark, rows, keyed.delayed_delete(), scratch(spark, "deletes"))
    return out.select(F.col("message_id").alias("id"), F.expr("timestampadd(MICROSECOND, delete_at_us, TIMESTAMP_NTZ '1970-01-01 00:00:00')").alias("delete_at"))
