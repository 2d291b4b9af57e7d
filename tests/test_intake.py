"""Edge cases of intake, settings, enforcement, media and the text pass."""

import json

import pytest
from pyspark.sql import functions as F

from vigilake.operators import enforcement, intake, media, settings, state, text_pass


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_nothing_is_done_without_rights(spark):
    t, f = F.lit(True), F.lit(False)
    run = lambda action, *flags: one(spark, enforcement.execute(F.lit(action), *flags)).c0
    assert tuple(run("ban", t, f, t, t, t, t, t)) == (False, False, False, ["missing_admin"])
    assert tuple(run("warn", t, f, f, f, t, t, t)) == (False, False, False, [])
    assert tuple(run("ban", t, t, f, f, t, t, t)) == (False, False, False, ["missing_delete_perm", "missing_ban_perm"])
    assert tuple(run("mute", f, t, t, t, t, t, t)) == (False, False, True, [])
    assert tuple(run("delete", t, t, t, t, f, t, t)) == (False, False, False, ["missing_delete_perm"])


def test_every_change(spark):
    steps = [("adjust_threshold", "90"), ("set_policy", "strict"), ("set_action", "vaporise"), ("toggle_custom", "bio_link"), ("toggle_custom", "bio_link"), ("toggle_category", "PORN"),
             ("toggle_media_kind", "video"), ("toggle_text_topic", "scam"), ("set_lang", "fa"), ("set_grace", "-3"), ("set_media_frames", "99"), ("toggle_notify", None), ("unknown", "1")]
    changes = spark.createDataFrame([(1, k, *s) for k, s in enumerate(steps)], "chat_id long, seq long, change string, value string")
    groups = spark.createDataFrame([(1, 35), (2, None)], "chat_id long, threshold int")
    got = {r.chat_id: r for r in settings.fold_changes(groups, changes).collect()}
    r = got[1]
    assert (r.threshold, r.policy, r.action, r.custom_filters, r.nsfw_categories) == (100, "strict", "ban", [], ["hentai", "sexy"])
    assert (r.media_kinds, r.text_topics, r.lang, r.lang_locked, r.grace, r.media_frames) == (["photo", "animation", "sticker"], ["sexual", "scam"], "fa", True, 0, 12)
    assert r.epoch == 10 and got[2].threshold == 40
    reset = changes.unionByName(spark.createDataFrame([(1, 99, "reset", None)], changes.schema))
    r = next(r for r in settings.fold_changes(groups, reset).collect() if r.chat_id == 1)
    assert (r.threshold, r.lang, r.lang_locked, r.nsfw_categories) == (40, "fa", True, settings.DEFAULT_CATEGORIES)
    assert settings.fold_changes(groups.limit(0), changes.limit(0)).count() == 0


def test_appeal_after_resolution_is_a_new_one(spark):
    rows = [(1, 1, 1, "approve"), (1, 1, 2, "open"), (1, 1, 3, "open"), (1, 1, 4, "reject"), (1, 1, 5, "open"), (2, 1, 1, "reject")]
    out = state.fold_appeals(spark.createDataFrame(rows, "chat_id long, user_id long, seq long, event string")).collect()
    assert sorted(tuple(r)[2:] for r in out) == [(1, 2, 4, "rejected", 2), (2, 5, None, "open", 1)]


def test_keyed_folds_are_linear(spark):
    import time

    times = []
    for n in (20_000, 80_000):
        events = spark.range(n).selectExpr("0 AS user_id", "id AS ts_us", "0.5D AS bar", "0.1D AS fast", "false AS verified")
        start = time.perf_counter()
        assert state.cached_answers(events, ["user_id"], 1).count() == n
        times.append(time.perf_counter() - start)
    assert times[1] < 12 * times[0]


def test_images(spark):
    got = one(spark, media.decoded(F.lit("YWI="), 2), media.decoded(F.lit("YWI"), 9), media.decoded(F.lit("YW I="), 9), media.decoded(F.lit("YWJj"), 2), media.decoded(F.lit(""), 2))
    assert [None if x is None else bytes(x) for x in got] == [b"ab", None, None, None, b""]
    detail = lambda v, frame: media.scoring_detail(F.lit(0.88), F.lit(0.07), F.lit(v), F.expr("array(named_struct('label', 'drawings', 'value', 0.76D))"), frame, F.lit(5))
    assert list(one(spark, detail(True, F.lit(4)), detail(False, F.lit(None).cast("int")))) == ["88% → 7% · drawings 76% · frame 4/5", "7%"]
    assert media.check_labels(["Porn", "neutral"], ["porn"]) == ["Porn"]
    for bad in (["hentai"], []):
        with pytest.raises(ValueError):
            media.check_labels(["porn"], bad)
    assert list(one(spark, media.read_words(F.lit(None).cast("string"), F.lit(" a \n b\t")), media.read_words(F.lit("x"), F.lit("a")), media.read_words(F.lit(None).cast("string"), F.lit(" ")))) == ["a b", None, None]


def test_text_pass(spark):
    assert list(one(spark, *[text_pass.route(F.lit("a long message"), F.lit(n), g) for n, g in ((3, F.lit(None).cast("double")), (3, F.lit(0.29)), (2, F.lit(0.0)), (0, F.lit(0.9)))])) == ["full", "ordinary", "full", "nothing"]
    assert list(one(spark, text_pass.chosen(F.lit("fa"), F.lit(0.6)), text_pass.chosen(F.lit("fa"), F.lit(None).cast("double")), text_pass.group_language(F.lit(None).cast("string"), F.lit("чат")))) == ["fa", None, "ru"]
    null = F.lit(None).cast("string")
    assert list(one(spark, text_pass.substantive(null, null, F.lit("unknown")), text_pass.substantive(null, F.lit("x"), null), text_pass.substantive(F.lit(" ab "), null, F.lit("absent")))) == [False, True, False]
    profile = json.loads(one(spark, text_pass.profile_state(F.lit('a "b"'), null, F.lit("x" * 700), F.lit("unknown"), null, null, null)).c0)["telegram_profile"]
    assert profile["display_name"] == 'a "b"' and profile["username"] is None and profile["attached_channel"] == "not looked up" and len(profile["bio"]) == 601


def test_unknown_is_no_pass(spark):
    none = F.lit(None).cast("boolean")
    assert list(one(spark, intake.wants_anything(none, F.lit(True)), intake.wants_anything(none), intake.in_scope(F.lit(None).cast("string")), intake.has_profile(F.lit(1), none))) == [True, False, False, True]


def test_callbacks_round_trip(spark):
    from vigilake.functions import callbacks

    values = {"": None, "number": "-7", "numbers": "1:-2", "text": "x", "policy": "strict", "action": "ban", "lang": "fa", "topic": "scam", "kind": "video"}
    rows = [(name, values[kind]) for name, (_, kind) in callbacks.CODES.items()]
    df = spark.createDataFrame(rows, "change string, value string")
    said = df.withColumn("data", callbacks.encode(F.col("change"), F.col("value")))
    for r in said.withColumn("d", callbacks.decode(F.col("data"))).collect():
        assert tuple(r.d) == (r.change, r.value) and len(r.data.encode()) <= 64
    assert list(one(spark, *[callbacks.unban_target(F.lit(u).cast("long"), F.lit(a)) for u, a in ((5, "6"), (None, " #17 "), (None, "x"), (None, None))])) == [5, 17, None, None]


def test_images_of_a_folder_and_model_metadata(spark, tmp_path):
    from vigilake.sources import lookups

    for name in ("b.png", "a.JPG", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert {r.id: bytes(r.content) for r in lookups.image_folder(spark, f"file://{tmp_path}").collect()} == {"b.png": b"b.png", "a.JPG": b"a.JPG"}
    (tmp_path / "model.json").write_text('{\n"labels": ["porn", "neutral"], "nsfw_labels": ["porn"], "size": 224, "mean": [0.5], "std": [0.5]}')
    r = lookups.model_metadata(spark, f"file://{tmp_path}/model.json").first()
    assert media.check_labels(r.labels, r.nsfw_labels) == ["porn"] and r.size == 224
    context = lookups.media_only(spark.range(1).withColumnRenamed("id", "user_id")).first()
    assert (context.channel_state, context.photos, context.bio, context.profile_nsfw) == ("unknown", "unknown", None, None)
