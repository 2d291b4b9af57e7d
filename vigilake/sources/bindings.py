"""Domain views over the star-schema tables, in Spark and in SQL, so that both engines see the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF, EARLIER = "2024-01-31 00:00:00", "2024-02-20 00:00:00"
POLICIES = ["nsfw_only", "nsfw_and_contact", "nsfw_or_keywords", "strict", "custom"]
ACTIONS = ["report", "warn", "delete", "mute", "ban"]
LABELS = ["drawings", "hentai", "neutral", "porn", "sexy"]
VERIFIER_BASE = ["hentai", "porn"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], k: str):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"int({k} % {len(values)}) + 1"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group for each nation: settings follow from the key."""
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("chat_id"),
        F.col("n_name").alias("title"),
        F.expr("CAST(30 + (n_nationkey % 5) * 10 AS INT)").alias("threshold"),
        _pick(POLICIES, "n_nationkey").alias("policy"),
        _pick(ACTIONS, "(n_nationkey div 5)").alias("action"),
        F.expr("CAST((n_nationkey % 4) * 2 AS INT)").alias("grace"),
        F.expr("n_nationkey % 7 = 0").alias("dry_run"),
        F.expr("n_nationkey % 3 <> 0").alias("is_active"),
        F.expr("CAST(n_nationkey * 11 AS BIGINT)").alias("member_count"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection for each event."""
    return detection_rows(read(spark, sf_dir, "events"))


def detection_rows(events: DataFrame) -> DataFrame:
    """Detections of a table or stream of events."""
    return events.select(
        F.col("event_id").alias("id"),
        F.expr("CAST(get_json_object(props, '$.k') AS BIGINT) % 25").alias("chat_id"),
        "user_id",
        F.least(F.col("value") / 500, F.lit(1.0)).alias("score"),
        F.expr("event_type = 'error'").alias("banned"),
        F.expr("event_type IN ('error', 'purchase')").alias("deleted"),
        F.expr("event_type = 'signup'").alias("muted"),
        "event_type",
        F.col("ts").alias("created_at"),
    )


def bans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ban events and pardon events."""
    d = detections(spark, sf_dir)
    return (
        d.filter("banned").select("chat_id", "user_id", "id", "score", F.col("created_at").alias("banned_at")),
        d.filter("muted").select("chat_id", "user_id", F.col("created_at").alias("unbanned_at")),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.expr("c_acctbal > 0").alias("started_bot"),
        F.expr("c_mktsegment = 'BUILDING'").alias("is_blocked"),
    )


def prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("long").alias("chat_id"), F.col("s_suppkey").alias("admin_id"), F.expr("s_acctbal > 0").alias("dm_notify")
    )


def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening score and five-class logits of each image; ten images to a medium."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.expr("vec_id div 10").alias("media_id"),
        F.expr("(vec_id div 10) % 25").alias("chat_id"),
        F.expr("transform(slice(embedding, 1, 5), x -> CAST(x AS DOUBLE) * 3)").alias("logits"),
        F.expr("1 / (1 + exp(-3 * CAST(embedding[5] AS DOUBLE)))").alias("fast"),
    )


def _case(values: list[str], k: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({k} % {len(values)} AS INT) + 1)"


SQL = {
    "groups": f"""SELECT CAST(n_nationkey AS BIGINT) AS chat_id, n_name AS title, CAST(30 + (n_nationkey % 5) * 10 AS INT) AS threshold,
        {_case(POLICIES, 'n_nationkey')} AS policy, {_case(ACTIONS, '(n_nationkey // 5)')} AS action,
        CAST((n_nationkey % 4) * 2 AS INT) AS grace, n_nationkey % 7 = 0 AS dry_run, n_nationkey % 3 <> 0 AS is_active,
        CAST(n_nationkey * 11 AS BIGINT) AS member_count FROM nation""",
    "detections": """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS chat_id, user_id,
        least(value / 500, 1.0) AS score, event_type = 'error' AS banned, event_type IN ('error', 'purchase') AS deleted,
        event_type = 'signup' AS muted, event_type, ts AS created_at FROM events""",
    "last_bans": """SELECT chat_id, user_id, id, score, created_at AS banned_at FROM detections WHERE banned
        QUALIFY row_number() OVER (PARTITION BY chat_id, user_id ORDER BY created_at DESC, id DESC) = 1""",
    "bans": """SELECT b.*, (SELECT max(created_at) FROM detections p WHERE p.muted AND p.chat_id = b.chat_id AND p.user_id = b.user_id
        AND p.created_at > b.banned_at) AS unbanned_at FROM last_bans b""",
    "users": "SELECT c_custkey AS user_id, c_name AS name, c_acctbal > 0 AS started_bot, c_mktsegment = 'BUILDING' AS is_blocked FROM customer",
    "prefs": "SELECT CAST(s_nationkey AS BIGINT) AS chat_id, s_suppkey AS admin_id, s_acctbal > 0 AS dm_notify FROM supplier",
    "image_scores": """SELECT vec_id AS image_id, vec_id // 10 AS media_id, (vec_id // 10) % 25 AS chat_id,
        list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE) * 3) AS logits,
        1 / (1 + exp(-3 * CAST(embedding[6] AS DOUBLE))) AS fast FROM embeddings""",
    "image_labels": f"""SELECT * EXCLUDE (e), list_transform(e, lambda x: x / list_sum(e)) AS p, {LABELS!r} AS names
        FROM (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM image_scores)""",
}
_USES = {"last_bans": ["detections"], "bans": ["last_bans"], "image_labels": ["image_scores"]}


def sql(views: str, query: str) -> str:
    """``query`` with the named views, and what they use, before it."""
    names: list[str] = []

    def add(name):
        for other in _USES.get(name, []):
            add(other)
        if name not in names:
            names.append(name)

    for v in views.split():
        add(v)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + query if names else query
