"""Registered queries of what follows from a judgement, and of what models answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.functions import callbacks
from vigilake.operators import enforcement, media, text_pass
from vigilake.plans.queries import _ENFORCED
from vigilake.plans.registry import query
from vigilake.sources import bindings as b
from vigilake.sources import lookups


def _done(spark, sf):
    """Verdicts on events with what was done about them."""
    d = b.detections(spark, sf).join(b.groups(spark, sf).select("chat_id", "action", "dry_run"), "chat_id")
    yes, c = F.lit(True), F.col
    d = d.withColumns({"matched": c("score") >= 0.2, "action": F.when((c("score") >= 0.2) & ~c("dry_run"), c("action")).otherwise("report"), "reasons": F.array(F.lit("bio_link")), "ts": c("created_at"), "message_id": F.when(c("id") % 4 != 0, c("id"))})
    return d.withColumn("done", enforcement.execute(c("action"), c("message_id").isNotNull(), yes, c("id") % 5 != 0, c("id") % 3 != 0, yes, yes, yes))


@query(f"SELECT chat_id, user_id, round(score, 6) AS score, created_at AS banned_at FROM (SELECT id FROM ({_ENFORCED}) e WHERE e.banned) JOIN detections USING (id)", "detections groups")
def ban_intake(spark, sf):
    """SNK03, X16: the rows that the fold of bans takes in."""
    return enforcement.ban_rows(_done(spark, sf)).select("chat_id", "user_id", F.round("score", 6).alias("score"), "banned_at")


@query(
    """SELECT d.id, coalesce(CASE WHEN user_id % 3 = 0 THEN stored END, stored, grp, 'en') AS lang FROM (SELECT *, CASE user_id % 4 WHEN 0 THEN 'fa' WHEN 1 THEN 'ru' END AS stored, CASE WHEN chat_id % 2 = 0 THEN 'ar' END AS grp FROM detections) d""",
    "detections",
)
def notice_languages(spark, sf):
    """an account's own language, its group's, or the default."""
    stored, group = F.expr("CASE user_id % 4 WHEN 0 THEN 'fa' WHEN 1 THEN 'ru' END"), F.expr("IF(chat_id % 2 = 0, 'ar', NULL)")
    return b.detections(spark, sf).select("id", enforcement.notice_language(stored, F.col("user_id") % 3 == 0, group).alias("lang"))


@query("SELECT image_id, CASE WHEN image_id % 9 = 0 THEN 'unavailable' WHEN round(least(1, greatest(0, fast)) * 100) >= 40 THEN 'over' ELSE 'under' END AS answer FROM image_scores", "image_scores")
def private_tests(spark, sf):
    """ML17: every image as a private test against the default threshold; every ninth can't be scored."""
    score = F.when(F.col("image_id") % 9 != 0, F.col("fast"))
    return b.image_scores(spark, sf).select("image_id", enforcement.score_of_private_test(score, F.lit(40)).alias("answer"))


@query("SELECT image_id, CASE WHEN image_id % 7 <> 0 THEN round(p[2] + p[4], 6) END AS nsfw, CASE WHEN image_id % 7 <> 0 THEN round(1 - round(p[2] + p[4], 6), 6) END AS sfw FROM image_labels", "image_labels")
def classified_images(spark, sf):
    """F41, AG10, ML03, ML04: shares of the model's explicit labels; none after an error."""
    rows = media.labelled(b.image_scores(spark, sf), b.LABELS).withColumn("error", F.when(F.col("image_id") % 7 == 0, "undecodable"))
    return media.classified(rows, media.check_labels(b.LABELS, ["Hentai", "PORN"])).select("image_id", "nsfw", "sfw")


@query("SELECT image_id, CASE WHEN image_id % 2 = 0 THEN least(0.4, 0.3 + image_id % 5 / 10) ELSE 0.3 + image_id % 5 / 10 END AS bar FROM image_scores", "image_scores")
def verify_bars(spark, sf):
    """ML09: a score that two passes share is checked at the lower of their bars."""
    return b.image_scores(spark, sf).select("image_id", media.verify_bar(F.lit(0.4), F.expr("0.3D + image_id % 5 / 10"), F.col("image_id") % 2 == 0).alias("bar"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 >= 6 AND c_custkey % 4 <> 3 THEN 'ru' ELSE CASE WHEN c_custkey % 3 = 0 THEN 'fa' ELSE 'en' END END AS lang FROM customer")
def group_languages(spark, sf):
    """ML15, F33: the model's answer from a confidence of 0.6, else the script of the title; every fourth answer has no confidence."""
    confidence = F.expr("IF(c_custkey % 4 <> 3, c_custkey % 10 / 10.0D, NULL)")
    title = F.concat(F.expr("IF(c_custkey % 3 = 0, 'گروه دوستان همیشگی چت گپ', 'group')"))
    return b.read(spark, sf, "customer").select("c_custkey", text_pass.group_language(text_pass.chosen(F.lit("ru"), confidence), title).alias("lang"))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN user_id WHEN id % 7 = 6 THEN NULL ELSE id * 3 END AS target FROM detections", "detections")
def unban_targets(spark, sf):
    """CT02: the author replied to, else a number with or without #; every seventh argument is none."""
    args = F.expr("CASE id % 7 WHEN 6 THEN 'x12' WHEN 5 THEN concat(' #', id * 3, ' ') ELSE concat('', id * 3) END")
    return b.detections(spark, sf).select("id", callbacks.unban_target(F.when(F.col("id") % 5 == 0, F.col("user_id")), args).alias("target"))


@query("SELECT id, false AS any_available, '' AS triggered FROM detections", "detections")
def media_only_contexts(spark, sf):
    """Where nothing of a profile was looked up, no signal of it is there and none fires; the display name is the message's own."""
    from vigilake.operators import signals

    rows = lookups.media_only(b.detections(spark, sf).select("id")).withColumns({"display_name": F.lit("Maryam"), "username": F.lit(None).cast("string"), "message_nsfw": F.lit(None).cast("double"), "threshold": F.lit(40), "global_blocklist": F.lit(True), "reputation_min_bans": F.lit(1)})
    s = signals.with_signals(rows)
    looked_up = ["profile_nsfw", "bio_link", "profile_channel", "bio_semantic", "profile_ocr", "no_photo_link", "reputation"]
    there = F.lit(False)
    for name in looked_up:
        there = there | F.col(f"signals.{name}.available")
    return s.select("id", there.alias("any_available"), F.array_join(signals.triggered_ids(), ",").alias("triggered"))


@query("SELECT doc_id, 'scam ' || CAST(round(doc_id % 101 / 100 * 100) AS INT) || '%' AS detail, coalesce('@' || CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 3 = 1 THEN source END, 'private channel') AS label, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || source ELSE lang END AS name FROM documents")
def named_things(spark, sf):
    """SG11, F10, F11: a topic's detail, a channel's label, a name of one part or two."""
    from vigilake.functions import text

    topic = F.struct(F.lit("scam").alias("id"), (F.col("doc_id") % 101 / 100).alias("certainty"))
    d = b.read(spark, sf, "documents")
    return d.select(
        "doc_id", text_pass.topic_detail(topic).alias("detail"), text.channel_label(F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 1, F.col("source"))).alias("label"),
        text.display_name(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("name"),
    )


@query(
    """SELECT media_id, chat_id, CASE WHEN top < 0.6 THEN round(top, 6) END AS score, false AS verified FROM (SELECT media_id, chat_id, max(fast) AS top FROM image_scores GROUP BY ALL)""",
    "image_scores",
)
def cascade_without_verifier(spark, sf):
    """ML06: what is flagged and can't be verified is unknown."""
    return media.cascade(b.image_scores(spark, sf), F.lit(0.6), None).withColumn("score", F.round("score", 6))


@query(
    """SELECT media_id, round(score, 6) AS score, frame, n AS of FROM (SELECT media_id, max(s) AS score, CASE WHEN count(*) > 1 THEN arg_max(k, (s, -k)) END::INT AS frame, CASE WHEN count(*) > 1 THEN count(*) END::INT AS n
      FROM (SELECT media_id, image_id % 10 AS k, p[2] + p[4] AS s FROM image_labels WHERE media_id % 4 <> 0 AND image_id % 7 <> 0 AND image_id % 10 < 5) GROUP BY media_id
    UNION ALL SELECT media_id, p[2] + p[4], NULL, NULL FROM image_labels WHERE media_id % 4 = 0 AND image_id % 10 = 9 AND image_id % 11 <> 0)""",
    "image_labels",
)
def clip_scores(spark, sf):
    """ML08, X10: five frames of each medium; every fourth medium can't be sampled and goes by its still, if that can be scored."""
    from vigilake.functions import scores

    i = F.col("image_id")
    images = media.labelled(b.image_scores(spark, sf), b.LABELS)
    frames = images.filter((F.col("media_id") % 4 != 0) & (i % 10 < 5)).withColumns({"position": i % 10, "error": F.when(i % 7 == 0, "undecodable")})
    stills = images.filter(i % 10 == 9).filter("media_id % 4 = 0").withColumn("error", F.when(i % 11 == 0, "undecodable"))
    own = scores.category_score(F.col("labels"), F.array(*map(F.lit, b.VERIFIER_BASE)))
    return media.clip_scores(frames, stills, own).select("media_id", F.round("score", 6).alias("score"), "frame", "of")


@query(
    """, u AS (SELECT count(*) FILTER (WHERE started_bot) AS started, count(*) FILTER (WHERE started_bot AND NOT is_blocked) AS reachable FROM users), g AS (SELECT count(*) AS groups, count(*) FILTER (WHERE is_active) AS active_groups, coalesce(sum(member_count) FILTER (WHERE is_active), 0)::BIGINT AS members FROM groups),
    d AS (SELECT count(*) AS detected_all, count(*) FILTER (WHERE banned) AS banned_all FROM detections), t AS (SELECT chat_id, title, count(*) AS hits FROM detections JOIN groups USING (chat_id) WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY ALL ORDER BY hits DESC, chat_id LIMIT 5)
    SELECT u.*, g.*, d.*, (SELECT string_agg(title || ' ' || hits, ', ' ORDER BY hits DESC, chat_id) FROM t) AS top FROM u, g, d""",
    "users groups detections",
)
def info_report(spark, sf):
    """CT08: reach, totals and the top groups, in one row."""
    from vigilake.operators import stats

    d, g = b.detections(spark, sf), b.groups(spark, sf)
    top = stats.top_groups(g, d, b.AS_OF)  # five rows
    line = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("k"), "chat_id", F.concat_ws(" ", "title", "hits").alias("said")))).alias("t"))
    line = line.select(F.array_join(F.transform("t", lambda x: x["said"]), ", ").alias("top"))
    totals = stats.overall(d, b.AS_OF).select("detected_all", "banned_all")
    return stats.reach(b.users(spark, sf), g).crossJoin(totals).crossJoin(line)  # one row each


class LengthModel:
    """A stand-in for an image model: shares follow from the number of bytes; some images can't be read, and one bad image fails its whole call."""

    labels = ["porn", "hentai", "neutral"]
    explicit = ["Porn", "hentai"]

    def score(self, images):
        if any(len(x) % 7 == 0 for x in images):
            raise ValueError("undecodable")
        shares = [(len(x) % 11 / 20, len(x) % 5 / 20) for x in images]
        return [{"porn": p, "hentai": h, "neutral": 1 - p - h} for p, h in shares]


@query(
    """SELECT doc_id AS image_id, CASE WHEN n % 7 <> 0 THEN round(n % 11 / 20 + n % 5 / 20, 6) END AS fast, CASE WHEN n % 7 <> 0 THEN round(1 - n % 11 / 20 - n % 5 / 20, 6) END AS neutral, CASE WHEN n IS NULL THEN 'no image' WHEN n % 7 = 0 THEN 'undecodable' END AS error
    FROM (SELECT doc_id, strlen(text) AS n FROM documents)"""
)
def model_scores(spark, sf):
    """2.13, ML02, ML04: every document's bytes as an image, through the place for models."""
    from vigilake.operators import models

    images = b.read(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.col("text").cast("binary").alias("content"))
    neutral = F.element_at(F.map_from_entries("labels"), "neutral")
    return models.scored(images, LengthModel).select("image_id", F.round("fast", 6).alias("fast"), F.round(neutral, 6).alias("neutral"), "error")
