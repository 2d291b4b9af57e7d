"""Contexts through signals and policies to verdicts, and goldens of the helpers."""

import pytest
from pyspark.sql import functions as F

from vigilake.functions import reports, scores, text
from vigilake.operators import media, policy, settings, signals, state
from vigilake.plans import queries as plans

CLEAN = {
    "display_name": "Maryam", "username": "maryam", "bio": "Photographer in Tehran", "channel_state": "absent", "channel_title": None, "channel_username": None,
    "photos": "visible", "profile_nsfw": 0.02, "message_nsfw": None, "avatar_text": None, "profile_ad": None, "other_group_bans": 0, "global_blocklist": True,
    "reputation_min_bans": 3, "threshold": 40, "policy": "nsfw_and_contact", "action": "ban", "custom": [], "dry_run": False,
}
SCHEMA = """display_name string, username string, bio string, channel_state string, channel_title string, channel_username string, photos string, profile_nsfw double,
message_nsfw double, avatar_text string, profile_ad double, other_group_bans long, global_blocklist boolean, reputation_min_bans int, threshold int, policy string, action string,
custom array<string>, dry_run boolean"""
CASES = [
    ("ordinary user", {}, False, "report"),
    ("spam profile", {"profile_nsfw": 0.93, "bio": "t.me/joinchat/x"}, True, "ban"),
    ("racy avatar only", {"profile_nsfw": 0.88}, False, "report"),
    ("link only", {"bio": "https://x.example.com/a"}, False, "report"),
    ("contact on avatar", {"profile_nsfw": 0.77, "avatar_text": "call @handle_x"}, True, "ban"),
    ("channel and picture", {"profile_nsfw": 0.91, "channel_state": "linked", "channel_title": "x"}, True, "ban"),
    ("unknown channel", {"profile_nsfw": 0.95, "channel_state": "unknown", "bio": None}, False, "report"),
    ("hidden avatar with link", {"photos": "absent", "profile_nsfw": None, "bio": "t.me/x"}, False, "report"),
    ("at the threshold", {"profile_nsfw": 0.45, "bio": "t.me/x"}, True, "ban"),
    ("below a higher threshold", {"profile_nsfw": 0.45, "bio": "t.me/x", "threshold": 60}, False, "report"),
    ("test mode", {"profile_nsfw": 0.93, "bio": "t.me/x", "dry_run": True}, True, "report"),
    ("banned elsewhere", {"other_group_bans": 4}, True, "ban"),
    ("banned twice", {"other_group_bans": 2}, False, "report"),
    ("opted out", {"other_group_bans": 9, "global_blocklist": False}, False, "report"),
    ("custom, one missing", {"policy": "custom", "custom": ["profile_nsfw", "bio_keywords"], "profile_nsfw": 0.9}, False, "report"),
    ("custom, all there", {"policy": "custom", "custom": ["profile_nsfw", "bio_keywords"], "profile_nsfw": 0.9, "bio": "my nudes"}, True, "ban"),
    ("custom without filters", {"policy": "custom", "profile_nsfw": 0.9}, False, "report"),
    ("advert by the model", {"policy": "nsfw_or_keywords", "profile_ad": 0.94}, True, "ban"),
    ("strict takes list and model as one", {"policy": "strict", "profile_ad": 0.97, "bio": "nudes"}, False, "report"),
    ("strict with two kinds", {"policy": "strict", "profile_ad": 0.97, "profile_nsfw": 0.9}, True, "ban"),
    ("exact at float", {"profile_nsfw": 0.7, "threshold": 70, "policy": "nsfw_only"}, True, "ban"),
]


def test_contexts_to_verdicts(spark):
    names = list(CLEAN)
    df = spark.createDataFrame([tuple({**CLEAN, **over}[n] for n in names) for _, over, _, _ in CASES], SCHEMA)
    out = signals.with_signals(df).withColumn("t", signals.triggered_ids())
    top = policy.headline_score(F.col("signals.profile_nsfw.score"), F.col("signals.message_media.score"))
    rows = out.withColumn("v", policy.verdict(F.col("t"), top, F.col("policy"), F.col("action"), F.col("custom"), F.col("dry_run"))).collect()
    for (name, over, hit, action), r in zip(CASES, rows, strict=True):
        assert (r.v.matched, r.v.action) == (hit, action), name
        assert hit or (r.v.score == 0 and r.v.reasons == []), name
    by_name = {c[0]: r for c, r in zip(CASES, rows, strict=True)}
    hidden = by_name["hidden avatar with link"].signals
    assert hidden.no_photo_link.triggered and not hidden.profile_nsfw.available and not hidden.profile_nsfw.triggered
    assert not by_name["unknown channel"].signals.profile_channel.available and not by_name["unknown channel"].signals.bio_link.available
    assert by_name["spam profile"].v.reasons == ["bio_link", "profile_nsfw"] and by_name["spam profile"].v.score == pytest.approx(0.93)


def test_needs_follow_policies():
    assert signals.needs_of(policy.IMAGE) == {"photos", "media"}
    assert "ocr" not in signals.needs_of(policy.CONSULTED["nsfw_or_keywords"])
    assert signals.needs_of(["name_pattern", "unheard_of"]) == frozenset()


def test_text_goldens(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x")).alias("y")).first().y
    assert one(lambda x: text.truncate(x, 5), "héllo wörld") == "héll…" and one(lambda x: text.truncate(x, 5), "hello") == "hello"
    assert one(text.clip, "a" * 601) == "a" * 600 + "…"
    assert one(text.strip_html, "a <b>x</b> &amp;lt; <i") == "a x < "
    assert one(text.cache_key, " A  b\tC ") == "a b c"
    assert one(text.keywords, "Голые фото, ПОРНО, سکس") == ["سکس", "Голые фото"]  # a pattern reports its first match
    assert one(text.keywords, "ПОРНО x") == ["ПОРНО"] and one(text.keywords, None) == []
    assert one(text.detect_language, None) == "en"
    found = one(text.contacts, "see https://t.me/abc and foo.shop/x @user_1")
    assert (found.invites, found.mentions, found.urls) == (["t.me/abc"], ["@user_1"], ["foo.shop/x"])


def test_scores_and_reports(spark):
    row = spark.range(1).select(
        scores.percent(F.lit(0.285)).alias("p"),
        scores.certainty(F.lit(None).cast("double"), F.lit(2.0), F.lit(None).cast("int"), F.lit(3)).alias("full"),
        scores.certainty(F.lit(None).cast("double"), F.lit(2.0), F.lit(5), F.lit(3)).alias("half"),
        scores.certainty(F.lit(None).cast("double"), F.lit(2.0), F.lit(1), F.lit(3)).alias("none"),
        reports.score_line(F.array(F.lit("text_ad"))).alias("words"),
        reports.score_line(F.array().cast("array<string>")).alias("empty"),
        reports.language(F.lit(True), F.lit("fa"), F.lit("ru")).alias("locked"),
        policy.strongest(F.lit("warn"), F.lit(None).cast("string"), F.lit("mute")).alias("most"),
        policy.strongest(F.lit(None).cast("string")).alias("least"),
        media.verify_bar(F.lit(0.4), F.lit(0.9), F.lit(True)).alias("bar"),
    ).first()
    assert (row.full, row.half, row.none, row.words, row.empty, row.locked) == (1.0, 0.5, None, "report_score_text", "report_score", "fa")
    assert (row.most, row.least, row.bar) == ("mute", "report", 0.4)


def test_cascade_verifies_flagged_media_only(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.9), (2, 1, 0, 0.1), (3, 2, 0, 0.3)], "image_id long, media_id long, chat_id long, fast double")
    seen = []

    def verify(images):
        seen.extend(r.image_id for r in images.collect())
        return images.groupBy("media_id", "chat_id").agg(F.lit(0.05).alias("score"))

    rows = {r.media_id: (r.score, r.verified) for r in media.cascade(df, F.lit(0.5), verify).collect()}
    assert sorted(seen) == [1, 2] and rows == {1: (0.05, True), 2: (0.3, False)}


def test_greedy_fold_golden(spark):
    rows = [(1, f"2024-01-01 00:{m:02}:00") for m in (0, 5, 14, 15, 16, 31)]
    df = spark.createDataFrame(rows, "k int, t string").select("k", F.col("t").cast("timestamp_ntz").alias("ts"))
    got = [r.scanned_us for r in state.every_interval(df, ["k"], 900).orderBy("scanned_us").collect()]
    assert [(g - got[0]) // 60_000_000 for g in got] == [0, 15, 31]


def test_empty_tables(spark):
    events = spark.createDataFrame([], "chat_id long, user_id long, event_id long, ts timestamp_ntz")
    assert state.rate_limit(events, "user_id", 2, 60).count() == 0 and state.every_interval(events, ["user_id"], 60).count() == 0
    assert settings.parse(spark.createDataFrame([], "chat_id long, " + ", ".join(f"{c} string" for c in plans._READ_AS) + ", " + ", ".join(f"{c} int" for c in plans._CLAMPED) + ", " + ", ".join(f"{c} boolean" for c in plans._ON))).count() == 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(df.columns) >= {"matched", "action", "reasons"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_detection_ids_follow_from_their_keys(spark):
    from vigilake.operators import enforcement

    keys = [(1, 2, None), (1, None, 2), (None, 1, 2), (12, 3, 4), (1, 23, 4), (1, 2, 34), (1, 2, 3)]
    df = spark.createDataFrame(keys * 2, "a long, b long, c long")
    ids = [r[0] for r in df.select(enforcement.detection_id(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert len(set(ids)) == len(keys) and ids[: len(keys)] == ids[len(keys) :] and all(len(x) == 32 for x in ids)
