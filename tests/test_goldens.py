"""Hand-worked rows of the small functions."""

from pyspark.sql import functions as F

from vigilake.functions import scores, text
from vigilake.operators import media, settings, state


def test_names(spark):
    gold = {
        "Maryam": [], "join now 👉 t.me/x": ["invite link in name", "call to action in name", "pointer emoji in name"], "18+ click": ["age marker in name", "call to action in name"], "Смотри канал": ["call to action in name"],
        "@abcdef": ["invite link in name"], "watchtower": [], "جوین بزن": ["call to action in name"], "": [], "⬇ subscribe": ["call to action in name", "pointer emoji in name"], "жми": ["call to action in name"], "жмите": [],
    }
    rows = spark.createDataFrame([(n,) for n in gold], "n string").select("n", text.name_hits(F.col("n")).alias("h")).collect()
    assert {r.n: r.h for r in rows} == gold


def test_languages(spark):
    gold = {"Photo club": "en", "گروه چت": "fa", "مجموعة نقاش": "ar", "Чат": "ru", "123 🙂": "en", "abc где": "ru", "چت ab": "fa", "قناة": "ar", "ok привет всем": "ru", "سلام": "fa"}
    rows = spark.createDataFrame([(n,) for n in gold], "n string").select("n", text.detect_language(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in rows} == gold
    codes = {"fa-IR": "fa", "pes": "fa", "RU_ru": "ru", "ar": "ar", "de": "en", "tg": "fa", "": "en"}
    rows = spark.createDataFrame([(n,) for n in codes], "n string").select("n", text.language_of_code(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in rows} == codes


def test_frames_and_containers(spark):
    spreads = {(1, 5): [0], (3, 5): [0, 1, 2], (10, 5): [0, 2, 4, 7, 9], (100, 3): [0, 50, 99], (0, 4): [0], (9, 1): [0], (5, 5): [0, 1, 2, 3, 4]}
    rows = spark.createDataFrame(list(spreads), "n int, m int").select("n", "m", scores.frame_indexes(F.col("n"), F.col("m")).alias("f")).collect()
    assert {(r.n, r.m): r.f for r in rows} == spreads
    rows = [("a", b"\0\0\0\x18ftypisom", 2.0), ("b", b"\x1a\x45\xdf\xa3rest", None), ("c", b"GIF89a", 0.001)]
    df = spark.createDataFrame(rows, "id string, content binary, duration double")
    out = df.select("id", scores.container(F.col("content")).alias("kind"), scores.frame_rate(F.lit(5.0), F.col("duration")).alias("fps")).collect()
    assert [tuple(r) for r in out] == [("a", "mp4", 2.5), ("b", "matroska", 1.0), ("c", None, 30.0)]


def test_settings_rows(spark):
    on = ["dry_run", "lang_locked", "delete_bot_messages", "global_blocklist", "media_scan", "text_scan", "ad_scan", "reaction_scan", "ban_foreign_bots"]
    names = ["chat_id", "policy", "action", "media_action", "ad_action", "threshold", "media_frames", "ttl", "grace", "custom_filters", "categories", "media_kinds", "topics", "media_threshold", "text_threshold", "ad_threshold", "text_action", "lang", *on]
    rows = [
        (1, "Strict ", "BAN", None, "vaporise", 140, 9999, 1, -3, '["a", 3]', "not-a-list", '["photo","hologram","GIF"]', '["scam","x"]', 101, -1, 50, "Mute", "fa-IR", *[True] * 9),
        (2, None, "mute", "warn", "ban", -5, 0, 99999, 7, '["f1","f2"]', '["porn"]', "[]", "{}", None, None, None, None, None, *[None] * 9),
    ]
    types = dict.fromkeys(names, "string") | {"chat_id": "long"} | dict.fromkeys(["threshold", "media_frames", "ttl", "grace", "media_threshold", "text_threshold", "ad_threshold"], "int") | dict.fromkeys(on, "boolean")
    out = settings.parse(spark.createDataFrame(rows, ", ".join(f"{n} {types[n]}" for n in names))).select(*names).collect()
    off = [settings.DEFAULTS[c] for c in on]
    assert list(out[0]) == [1, "strict", "ban", "delete", "warn", 100, 12, 5, 0, [], ["porn", "hentai", "sexy"], ["photo", "animation"], ["scam"], 100, 0, 50, "mute", "fa", *[True] * 9]
    assert list(out[1]) == [2, "nsfw_and_contact", "mute", "warn", "ban", 0, 1, 86400, 7, ["f1", "f2"], ["porn"], [], [], None, None, None, "delete", "en", *off]


def test_toggle_fingerprint_kind_guard(spark):
    rows = spark.createDataFrame([(["a", "b"], "B"), (["a"], "c"), ([], "x")], "items array<string>, item string")
    assert [r[0] for r in rows.select(state.toggle(F.col("items"), F.col("item"))).collect()] == [["a"], ["a", "c"], ["x"]]
    photos = [([[("b1", 1, 1), ("b2", 5, 5)], [("a8", 3, 3), ("a9", 3, 3)]],), ([[("c1", 1, 9)]],), ([],)]
    df = spark.createDataFrame(photos, "photos array<array<struct<id string, w int, h int>>>")
    assert [r[0] for r in df.select(media.fingerprint(F.col("photos"))).collect()] == ["b2:a9", "c1", ""]
    parts = [("p", None, None, None, None), (None, "a", None, None, None), (None, None, "s", None, None), (None, None, None, "v", None), (None, None, None, None, "image/gif"), (None, None, None, None, "image/png"), (None, None, None, None, "video/mp4"), (None, None, None, None, "image/gifx"), (None, None, "s", "v", None), (None, None, None, None, "text/plain")]
    df = spark.createDataFrame(parts, "photo string, animation string, sticker string, video string, mime string")
    kinds = [r[0] for r in df.select(media.kind_of(*[F.col(c) for c in ("photo", "animation", "video", "sticker", "mime")])).collect()]
    assert kinds == ["photo", "animation", "sticker", "video", "animation", "photo", "animation", "photo", "video", None]
    df = spark.range(8).selectExpr("id % 2 = 1 AS s", "id div 2 % 2 = 1 AS a", "id div 4 = 1 AS r")
    out = [r[0] for r in df.select(media.bot_verdict(F.col("s"), F.col("a"), F.col("r"))).collect()]
    assert out == ["powerless", "leave", "leave", "leave", "ban", "leave", "leave", "leave"]


def test_cache_keeps_labels_of_the_same_photos_only(spark):
    columns = "user_id int, fingerprint string, pipeline string, fast double, scanned_at string, labels string"
    old = [(1, "f1", "v3", 0.8, "29", "old"), (2, "f1", "v3", 0.8, "29", "old"), (3, "f1", "v3", 0.8, "29", "old"), (5, "f5", "v2", 0.8, "30", "old"), (6, "f6", "v3", 0.8, "01", "old")]
    new = [(1, "f2", "v3", 0.2, "30", None), (2, "f1", "v3", 0.3, "30", None), (3, "f1", "v3", 0.7, "29", None), (3, "f1", "v3", 0.9, "30", "new"), (4, "f9", "v3", 0.1, "30", None)]
    make = lambda rows: spark.createDataFrame(rows, columns).withColumn("scanned_at", F.expr("CAST(concat('2024-01-', scanned_at) AS TIMESTAMP_NTZ)"))
    out = state.prune_cache(state.fold_cache(make(old), make(new)), "2024-01-31 00:00:00", 3, "v3").select("user_id", "fingerprint", "fast", "labels").collect()
    assert sorted(map(tuple, out)) == [(1, "f2", 0.2, None), (2, "f1", 0.3, "old"), (3, "f1", 0.9, "new"), (4, "f9", 0.1, None)]


def test_keywords_by_their_patterns(spark):
    """The patterns tried one by one, with odd letters and none."""
    words = ["PORN", "pOrnhub", "p0rnſ", "xxx", "nudeſ", "NUDES", "seX-chat", "onlyfanſ", "only fans", "eſcort", "CAMGİRL", "camgırl", "hentaI", "18+ videos", "adult  content", "ADULT CHANNEL", "سکس", "سکککس", "فیلم سوپر", "شماره مجازی سکس", "إباحي", "جنس ساخن", "ПОРНО", "секс чат", "интим услуг", "голых фото", "corn", "", "plain"]
    rows = [(f"{a} {b}",) for a in words for b in words[::3]] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    each = F.array(*[F.regexp_extract(F.coalesce("t", F.lit("")), text._unicode(p), 0) for p in text.KEYWORDS])
    out = df.select(text.keywords(F.col("t")).alias("got"), F.slice(F.filter(each, lambda s: s != ""), 1, 3).alias("want")).collect()
    assert all(r.got == r.want for r in out) and sum(bool(r.got) for r in out) > 200
