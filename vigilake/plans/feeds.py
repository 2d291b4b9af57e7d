"""Registered queries of feeds: raw updates in, deliveries out, results back to their requests, verdicts on reactions, evaluations."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from vigilake.operators import intake, media, policy, position, profile_cache, rollups, signals, state, stats
from vigilake.plans.moderation import _ANY, _BIOS, _CONTACT, _DISPLAY, _FIRES, _IMAGE, _LIST, _VOCABULARY
from vigilake.plans.queries import scratch
from vigilake.plans.registry import ORACLES, query
from vigilake.sources import bindings as b
from vigilake.sources import clips, updates
from vigilake.streaming import delivery

# ---- raw updates --------------------------------------------------------------------------------

#: What the messages of the raw updates say.
_WORDS = ["/start", "/help@our_bot", "/nsfw", "/unban #17", "/unban@Our_Bot 5  x", "/info", "/broadcast all of you", "/start@another_bot", "/Start", "hello /help", "/unknown", "/helpful", ""]
_HEARD = {0: ("start", ""), 1: ("help", ""), 2: ("nsfw", ""), 3: ("unban", "#17"), 4: ("unban", "5  x"), 5: ("info", ""), 6: ("broadcast", "all of you")}
_KIND = "CASE WHEN id % 13 = 0 THEN 'broken' WHEN id % 17 = 1 THEN 'poll' WHEN id % 19 = 2 THEN 'unnumbered' ELSE ['message', 'callback_query', 'message', 'my_chat_member', 'chat_member', 'message_reaction', 'message'][CAST(id % 7 AS INT) + 1] END"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as the JSON text of an update; some are cut off, of no known kind, or without a number."""
    d = b.detections(spark, sf)
    pick = F.expr("element_at(array('message', 'callback_query', 'message', 'my_chat_member', 'chat_member', 'message_reaction', 'message'), int(id % 7) + 1)")
    kind = F.when(F.col("id") % 13 == 0, "broken").when(F.col("id") % 17 == 1, "poll").when(F.col("id") % 19 == 2, "unnumbered").otherwise(pick)
    d = d.withColumns({"kind": kind, "words": F.element_at(F.array(*map(F.lit, _WORDS)), F.expr("int(id div 7 % 13) + 1"))})
    chat = F.struct(F.col("chat_id").alias("id"), F.when(F.col("id") % 5 == 0, "private").otherwise("supergroup").alias("type"))
    user = F.struct(F.col("user_id").alias("id"), (F.col("user_id") % 9 == 0).alias("is_bot"))
    status = lambda c: F.struct(F.when(c, "member").otherwise("left").alias("status"))
    when = lambda name, value: F.when(F.col("kind") == name, value).alias(name)
    date = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', created_at)").alias("date")
    member = F.struct(chat.alias("chat"), user.alias("from"), date, status(F.col("id") % 2 == 0).alias("old_chat_member"), status(F.col("id") % 3 == 0).alias("new_chat_member"))
    whole = F.struct(
        F.when(F.col("kind") != "unnumbered", F.col("id")).alias("update_id"),
        F.when(F.col("kind").isin("message", "unnumbered"), F.struct(F.col("id").alias("message_id"), chat.alias("chat"), user.alias("from"), date, F.when(F.col("id") % 11 != 3, F.col("words")).alias("text"), F.when(F.col("id") % 11 == 3, F.col("words")).alias("caption"))).alias("message"),
        when("callback_query", F.struct(F.col("id").cast("string").alias("id"), user.alias("from"), F.lit("p:not").alias("data"))),
        when("my_chat_member", member), when("chat_member", member),
        when("message_reaction", F.struct(chat.alias("chat"), user.alias("user"), F.col("id").alias("message_id"), date, F.array(F.lit("👍")).alias("new_reaction"))),
        when("poll", F.struct(F.col("id"))),
    )
    text = F.to_json(whole)
    return d.select(F.when(F.col("kind") == "broken", F.substring(text, F.lit(1), F.length(text) - 7)).otherwise(text).alias("value"))


def _updates(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Raw updates as text files, read as a stream of two files at a time, parsed, and kept."""
    place = scratch(spark, name)
    _raw(spark, sf).repartition(5).write.text(f"{place}/raw")
    rows = updates.parsed(updates.update_stream(spark, f"{place}/raw", 2), "our_bot")
    out = rows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/out")


_SAYS = "CASE CAST(id // 7 % 13 AS INT) " + " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in _HEARD.items()) + " END"
_ARGS = "CASE CAST(id // 7 % 13 AS INT) " + " ".join(f"WHEN {k} THEN '{a}'" for k, (_, a) in _HEARD.items()) + " END"


@query(
    f"""SELECT id AS update_id, CASE WHEN kind <> 'message' THEN replace(replace(replace(replace(kind, 'my_chat_member', 'own_member'), 'chat_member', 'member'), 'callback_query', 'callback'), 'message_reaction', 'reaction')
      WHEN command IS NOT NULL THEN 'command' WHEN id % 5 = 0 THEN 'private' ELSE 'group' END AS route, command, CASE WHEN command IS NOT NULL THEN args END AS args, CASE WHEN kind <> 'callback_query' THEN chat_id END AS chat_id, user_id,
      CASE WHEN kind IN ('my_chat_member', 'chat_member') THEN CASE WHEN id % 3 = 0 THEN 'member' ELSE 'left' END END AS new_status
    FROM (SELECT *, CASE WHEN kind = 'message' THEN {_SAYS} END AS command, {_ARGS} AS args FROM (SELECT *, {_KIND} AS kind FROM detections)) WHERE kind NOT IN ('broken', 'poll', 'unnumbered')""",
    "detections",
)
def update_routes(spark, sf):
    """SRC01, CT01: all six kinds and six commands, from raw JSON through a stream."""
    rows = _updates(spark, sf, "updates").filter("malformed IS NULL")
    return rows.select("update_id", "route", "command", "args", "chat_id", "user_id", "new_status")


@query(
    f"SELECT CASE kind WHEN 'broken' THEN 'no JSON object' WHEN 'poll' THEN 'unknown kind' ELSE 'no number' END AS malformed, count(*) AS n FROM (SELECT {_KIND} AS kind FROM detections) WHERE kind IN ('broken', 'poll', 'unnumbered') GROUP BY ALL",
    "detections",
)
def malformed_updates(spark, sf):
    """SRC01: what can't be read is set apart with its reason."""
    return _updates(spark, sf, "malformed").filter("malformed IS NOT NULL").groupBy("malformed").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT id, prior, message_id, matched, CASE WHEN matched AND NOT dry_run THEN action ELSE 'report' END AS action, CASE WHEN matched THEN score ELSE 0 END AS score, CASE WHEN matched THEN array_to_string(list_filter(t, lambda r: r = 'reputation' OR list_contains(CASE policy
      WHEN 'nsfw_only' THEN ['profile_nsfw', 'message_media'] WHEN 'nsfw_and_contact' THEN ['profile_nsfw', 'message_media', 'bio_link', 'profile_ocr', 'profile_channel']
      WHEN 'nsfw_or_keywords' THEN ['profile_nsfw', 'message_media', 'bio_keywords', 'name_pattern', 'bio_semantic'] WHEN 'custom' THEN ['bio_link', 'name_pattern']
      ELSE ['profile_nsfw', 'message_media', 'bio_link', 'profile_ocr', 'profile_channel', 'bio_keywords', 'name_pattern', 'bio_semantic'] END, r)), ',') ELSE '' END AS reasons FROM (
    SELECT event AS id, prior, NULL::BIGINT AS message_id, t, policy, action, dry_run, CASE WHEN id % 7 <> 0 THEN id % 11 ELSE 0 END / 10 AS score, list_contains(t, 'reputation') OR CASE policy WHEN 'nsfw_only' THEN """
    + f"""{_IMAGE} WHEN 'nsfw_and_contact' THEN {_IMAGE} AND {_CONTACT} WHEN 'nsfw_or_keywords' THEN {_IMAGE} OR {_VOCABULARY} WHEN 'strict' THEN {_IMAGE}::INT + {_CONTACT}::INT + {_VOCABULARY}::INT >= 2
      ELSE {_ANY('bio_link')} AND {_ANY('name_pattern')} END AS matched
    FROM (SELECT *, {_LIST(*[x for x in _FIRES.items() if x[0] != 'message_media'])} AS t FROM (
      SELECT user_id AS id, d.id AS event, chat_id, threshold, policy, action, dry_run, grace, (SELECT count(*) FROM detections p WHERE p.chat_id = d.chat_id AND p.user_id = d.user_id AND p.event_type = 'view' AND (p.created_at, p.id) < (d.created_at, d.id)) AS prior
      FROM detections d JOIN groups USING (chat_id) JOIN customer ON c_custkey = user_id WHERE event_type = 'click' AND chat_id % 2 = 0) WHERE NOT (grace > 0 AND prior > grace)))""",
    "detections groups",
)
def reaction_verdicts(spark, sf):
    """PL14, SRC03: a reaction within grace is judged by its author's profile alone; the verdict names no message."""
    e, c = F.expr, F.col
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), e(f"int(user_id % {n}) + 1"))
    d = state.prior_messages(b.detections(spark, sf), c("event_type") == "view", order=("created_at", "id"))
    d = d.withColumns({"kind": F.when(c("event_type") == "click", "reaction"), "chat_type": F.lit("supergroup"), "is_bot": F.lit(False), "new_reaction": F.array(F.lit("👍"))})
    groups = b.groups(spark, sf).select("chat_id", "threshold", "policy", "action", "dry_run", "grace", e("chat_id % 2 = 0").alias("reaction_scan"))
    rows = intake.reactions(d, groups).join(b.users(spark, sf).select("user_id"), "user_id")
    rows = rows.withColumns({
        "bio": pick(_BIOS, 6), "display_name": pick(_DISPLAY, 4), "username": F.lit(None).cast("string"), "channel_state": pick(["linked", "absent", "unknown"], 3), "channel_title": F.lit("news"), "channel_username": F.lit(None).cast("string"),
        "photos": pick(["absent", "unknown", "visible", "visible", "visible"], 5), "profile_nsfw": e("IF(user_id % 7 <> 0, user_id % 11 / 10.0D, NULL)"), "message_nsfw": F.lit(None).cast("double"),
        "avatar_text": e("CASE user_id % 8 WHEN 0 THEN '@spam_me' WHEN 1 THEN 'hello' END"), "profile_ad": e("IF(user_id % 9 <> 0, user_id % 10 / 10.0D, NULL)"), "other_group_bans": e("user_id % 6"),
        "global_blocklist": e("chat_id % 2 = 0"), "reputation_min_bans": F.lit(3),
    })
    s = signals.with_signals(rows).withColumn("triggered", signals.triggered_ids())
    v = policy.reaction_verdict(c("triggered"), c("profile_nsfw"), c("policy"), c("action"), F.array(F.lit("bio_link"), F.lit("name_pattern")), c("dry_run"))
    return s.withColumn("v", v).select("id", "prior", "v.message_id", "v.matched", "v.action", F.round("v.score", 6).alias("score"), F.array_join("v.reasons", ",").alias("reasons"))


# ---- deliveries ---------------------------------------------------------------------------------

_RUNS = [(1, 7, "all", "to all of you"), (2, 7, "groups", "to the groups"), (3, 9, "users", "to the users")]


def _send(targets: list[int], bodies: list[str]) -> list[str | None]:
    """Stands for the messenger: some users have blocked it, some groups have thrown it out, some calls fail."""
    return ["user_blocked" if t % 10 == 3 else "bot_kicked" if t % 10 == 5 else "timeout" if t % 10 == 7 else None for t in targets]


def _delivered(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, DataFrame]:
    recipients = stats.recipients(b.users(spark, sf), b.groups(spark, sf))
    runs = delivery.open_runs(spark.createDataFrame(_RUNS, "broadcast_id long, author_id long, target string, body string"), recipients)
    place = scratch(spark, name)
    box = delivery.outbox(runs, recipients)
    box.write.parquet(f"{place}/outbox")
    delivery.deliver(spark.readStream.schema(box.schema).option("maxFilesPerTrigger", 4).parquet(f"{place}/outbox"), place, _send)
    return runs, delivery.outcomes(spark, place)


_OUTCOMES = """SELECT broadcast_id, target, is_user, e, CASE WHEN e IS NULL THEN NULL WHEN is_user AND e = 'user_blocked' THEN 'is_blocked' WHEN NOT is_user AND e = 'bot_kicked' THEN 'inactive' ELSE 'failed' END AS failure
    FROM (SELECT *, CASE target % 10 WHEN 3 THEN 'user_blocked' WHEN 5 THEN 'bot_kicked' WHEN 7 THEN 'timeout' END AS e FROM (SELECT user_id AS target, true AS is_user FROM users WHERE started_bot AND NOT is_blocked UNION ALL SELECT chat_id, false FROM groups WHERE is_active)),
    (VALUES (1, true, true), (2, false, true), (3, true, false)) AS r(broadcast_id, u, g) WHERE CASE WHEN is_user THEN u ELSE g END"""


@query(f"SELECT CAST(broadcast_id AS BIGINT) AS broadcast_id, target, is_user, e AS error, failure FROM ({_OUTCOMES})", "users groups")
def broadcast_delivery(spark, sf):
    """SNK09, X17: each row of the outbox is sent once, with what its failure says of the target."""
    return _delivered(spark, sf, "delivery")[1].select("broadcast_id", "target", "is_user", "error", "failure")


@query(
    f"SELECT CAST(broadcast_id AS BIGINT) AS broadcast_id, CASE broadcast_id WHEN 3 THEN 9 ELSE 7 END::BIGINT AS author_id, count(*) AS total, count(*) FILTER (WHERE e IS NULL) AS sent, count(*) FILTER (WHERE e IS NOT NULL) AS failed, true AS finished FROM ({_OUTCOMES}) GROUP BY broadcast_id",
    "users groups",
)
def broadcast_runs(spark, sf):
    """DML17: the runs' rows, opened with their totals and closed with their counts."""
    runs, results = _delivered(spark, sf, "runs")
    return delivery.closed_runs(runs, results).select("broadcast_id", "author_id", "total", "sent", "failed", "finished")


# ---- results and requests -----------------------------------------------------------------------


def lengths(batches):
    """A scorer that gives one number for each text, in the order of the texts and without their ids."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pc.utf8_length(batch.column("text").fill_null("")).cast(pa.int64())], names=["score"])


@query("SELECT doc_id, length(coalesce(text, '')) AS score, NULL::VARCHAR AS mismatch FROM documents")
def zipped_results(spark, sf):
    """Results without ids, joined to their requests by place."""
    write = lambda df: _kept(spark, df)
    docs = b.read(spark, sf, "documents").select("doc_id", "text")
    results = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text").mapInArrow(lengths, "score long")
    both = position.zipped(docs.select("doc_id"), results, ["doc_id"], [], write)
    return both.select("request.doc_id", "result.score", F.col("mismatch"))


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    place = scratch(spark, "numbered")
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


# ---- evaluations --------------------------------------------------------------------------------


@query(
    f"""SELECT image_id, round(fast, 6) AS fast, round(p[2] + p[4], 6) AS score, names[i[1]] AS first, names[i[2]] AS second FROM (SELECT *, list_sort(list_transform([1, 2, 3, 4, 5], lambda k: struct_pack(v := -p[k], n := names[k], k := k))) AS o, list_transform(o, lambda x: x.k) AS i FROM image_labels)
    WHERE image_id % 3 <> 0 AND image_id % 4 <> 0""",
    "image_labels",
)
def evaluation_listing(spark, sf):
    """SE05, SO08: images that both evaluations hold, with both scores and the two strongest labels."""
    images = b.image_scores(spark, sf)
    screened = images.filter("image_id % 3 <> 0").select("image_id", "fast")
    verified = media.labelled(images.filter("image_id % 4 <> 0"), b.LABELS).select("image_id", "labels")
    out = stats.evaluated_by_both(screened, verified, "image_id", b.VERIFIER_BASE)
    return out.select("image_id", F.round("fast", 6).alias("fast"), F.round("score", 6).alias("score"), "first", "second")


# ---- clips --------------------------------------------------------------------------------------


@F.udf(BinaryType())
def _as_clip(doc_id: int, text: str | None) -> bytes:
    """A document as a clip: its lines are the samples; every eleventh is cut off."""
    raw = clips.packed([x.encode() for x in (text or "").split("\n")], wide=doc_id % 2 == 0)
    return raw[: len(raw) - 40] if doc_id % 11 == 0 else raw


@query(
    """SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN i END AS position, CASE WHEN doc_id % 11 <> 0 THEN n END AS total, CASE WHEN doc_id % 11 <> 0 THEN i / 25 END AS seconds, CASE WHEN doc_id % 11 <> 0 THEN strlen(lines[i + 1]) END AS size,
    CASE WHEN doc_id % 11 <> 0 THEN sha256(lines[i + 1]) END AS still, CASE WHEN doc_id % 11 <> 0 THEN i % 10 = 0 END AS is_key, doc_id % 11 = 0 AS failed
    FROM (SELECT *, unnest(CASE WHEN doc_id % 11 = 0 THEN [0] WHEN n <= 12 THEN range(n) ELSE list_distinct(list_transform(range(12), lambda k: CAST(round_even(k * (n - 1) / 11, 0) AS BIGINT))) END)::INT AS i
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, len(string_split(coalesce(text, ''), chr(10)))::INT AS n FROM documents))"""
)
def clip_frames(spark, sf):
    """ML07, ML04: at most twelve stills of each clip, with the bytes at their places; what can't be read says so."""
    made = b.read(spark, sf, "documents").select("doc_id", _as_clip("doc_id", "text").alias("content"))
    rows = made.lateralJoin(clips.frames(F.col("content").outer(), F.lit(clips.MOST)))
    still = F.expr("substring(content, int(offset) + 1, int(size))")
    return rows.select("doc_id", "position", "total", "seconds", "size", F.sha2(still, 256).alias("still"), "is_key", F.col("error").isNotNull().alias("failed"))


# ---- profiles, cache first ----------------------------------------------------------------------


@query(
    """, q AS (SELECT d.id, user_id, chat_id, 'p' || user_id % 3 AS fp, threshold / 100 AS th FROM detections d JOIN groups USING (chat_id)), bars AS (SELECT user_id, fp, min(th) AS bar FROM q GROUP BY ALL),
    c AS (SELECT c_custkey AS user_id, 'p' || c_custkey % 4 AS fp, c_custkey % 10 / 10 AS fast, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 9 / 10 END AS label FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 7 <> 0),
    m AS (SELECT b.user_id, b.fp, bar, c.fast, label, NOT coalesce(label IS NOT NULL OR c.fast < bar, false) AS miss, CASE WHEN b.user_id % 13 <> 0 THEN b.user_id * 3 % 11 / 10 END AS s FROM bars b LEFT JOIN c ON c.user_id = b.user_id AND c.fp = b.fp),
    a AS (SELECT user_id, fp, CASE WHEN miss THEN coalesce(s, fast) ELSE fast END AS fast, CASE WHEN NOT miss THEN label WHEN s >= bar AND user_id % 17 <> 0 THEN user_id % 10 / 10 END AS label, miss AND s >= bar AND user_id % 17 <> 0 AS fresh FROM m)
    SELECT id, CASE WHEN label IS NOT NULL THEN 'verified' WHEN fast < th THEN 'screened' ELSE 'unknown' END AS state, round(CASE WHEN label IS NOT NULL THEN CASE WHEN chat_id % 2 = 0 THEN label WHEN fresh THEN 0.05 ELSE 0 END WHEN fast < th THEN fast END, 6) AS score FROM q JOIN a USING (user_id, fp)""",
    "detections groups",
)
def profile_cache_pass(spark, sf):
    """X06, ST07, J05, P18, DML10, ML06: evidence for each event's author, from the cache, or scored once and kept."""
    e = F.expr
    rows = b.detections(spark, sf).join(b.groups(spark, sf).select("chat_id", "threshold"), "chat_id")
    requests = rows.select("id", "user_id", e("concat('p', user_id % 3)").alias("fingerprint"), e("threshold / 100.0D").alias("threshold"), e("IF(chat_id % 2 = 0, array('porn'), array('Sexy'))").alias("categories"))
    label = lambda value, more="": f"array(named_struct('label', 'porn', 'value', {value}){more})"
    cache = b.read(spark, sf, "customer").filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").cast("long").alias("user_id"), e("concat('p', c_custkey % 4)").alias("fingerprint"), e("IF(c_custkey % 7 = 0, 'v2', 'v3')").alias("pipeline"), e("c_custkey % 10 / 10.0D").alias("fast"),
        e("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("scanned_at"), e(f"IF(c_custkey % 5 = 0, {label('c_custkey % 9 / 10.0D')}, NULL)").alias("labels"),
    )
    screen = lambda d: d.withColumn("fast", e("IF(user_id % 13 <> 0, user_id * 3 % 11 / 10.0D, NULL)"))
    second = ", named_struct('label', 'sexy', 'value', 0.05D)"
    verify = lambda d: d.withColumn("labels", e(f"IF(user_id % 17 <> 0, {label('user_id % 10 / 10.0D', second)}, NULL)"))
    got, _ = profile_cache.resolve(requests, cache, screen, verify, "v3", F.lit(b.AS_OF), lambda df: _kept(spark, df))
    return got.select("id", "state", F.round("score", 6).alias("score"))


# ---- counters -----------------------------------------------------------------------------------

_NOON = "2024-01-29 12:34:56"  # in the middle of a day


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Rollups kept in three steps, of which two share a day."""
    d = b.detections(spark, sf)
    cuts = ["created_at < TIMESTAMP_NTZ '2024-01-10 07:00:00'", "created_at >= TIMESTAMP_NTZ '2024-01-10 07:00:00' AND created_at < TIMESTAMP_NTZ '2024-01-25 00:00:00'", "created_at >= TIMESTAMP_NTZ '2024-01-25 00:00:00'"]
    kept = rollups.by_day(d.filter(cuts[0]))
    for c in cuts[1:]:
        kept = _kept(spark, rollups.merged(kept, rollups.by_day(d.filter(c))))
    return kept


@query(ORACLES["stats_by_group"].replace(b.AS_OF, _NOON))
def rolling_counts(spark, sf):
    """AG01, F39: the counts of stats_by_group, from day rollups."""
    return rollups.by_group(_rollup(spark, sf), b.detections(spark, sf), _NOON)


@query(ORACLES["stats_global"].replace(b.AS_OF, _NOON))
def rolling_totals(spark, sf):
    """AG04: from day rollups."""
    return rollups.overall(_rollup(spark, sf), b.detections(spark, sf), _NOON)
