"""Exact deduplication against a dictionary of texts, and with a digest that collides."""

from pyspark.sql import functions as F

from vigilake.llm import exact_dedup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def groups(rows):
    out = {}
    for doc, text in rows:
        out.setdefault(lowered(text), []).append(doc)
    return out


ROWS = [(1, "A"), (2, "a"), (None, "a"), (3, None), (3, ""), (5, "Ä"), (6, "ä"), (1, "A"), (9, "x" * 100_000), (8, "X" * 100_000)]


def expect(rows):
    by = groups(rows)
    return sorted(
        (str(doc), str(max((d for d in by[lowered(t)] if d is not None), default=None)), len(by[lowered(t)])) for doc, t in rows
    )


def got(df):
    rows = df.collect()
    assert len({r.digest.hex() + str(r.keep_id) + str(r.group_size) for r in rows if r.kept}) == sum(r.kept for r in rows)
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows)


def test_small_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert got(exact_dedup.assign(df)) == expect(ROWS)
    assert exact_dedup.assign(df.limit(0)).count() == 0


def test_colliding_digests_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    weak = lambda t: F.unhex(F.rpad(F.hex(F.crc32(t.cast("binary")) % 2), 8, "0"))
    assert got(exact_dedup.assign(df, digest=weak)) == expect(ROWS)


def test_drop_copies_keeps_columns(spark, tmp_path):
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(ROWS)], "doc_id long, text string, row int")
    df.write.parquet(f"file://{tmp_path}/t")
    for source in (df, spark.read.parquet(f"file://{tmp_path}/t")):
        out = exact_dedup.drop_copies(source)
        assert out.columns == df.columns
        assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "3", "5", "6", "9"]


def test_state_takes_later_rows(spark, tmp_path):
    path, checkpoint = f"file://{tmp_path}/index", f"file://{tmp_path}/state"
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, locator_file string, locator_row long, digest binary")
    make([(1, "f", 0, b"a"), (2, "f", 1, b"b")]).write.parquet(path)
    index = spark.read.parquet(path)
    exact_dedup.fold(index, path, checkpoint).collect()
    make([(7, "g", 0, b"a")]).write.mode("append").parquet(path)
    state = {bytes(r.digest): (r.keep_id, r.group_size) for r in exact_dedup.fold(index, path, checkpoint).collect()}
    assert state == {b"a": (7, 2), b"b": (2, 1)}


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    out = exact_dedup.query(spark, data)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out.collect()) == expect(rows)


def test_columns_named_as_locators(spark):
    for names in ("locator_file string, locator_row long", "locator_file string"):
        rows = [(k, t, *["same" if "string" in n else 1 for n in names.split(", ")]) for k, t in enumerate(["Aa b", "aa b", None, "", "x"])]
        df = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
        kept = exact_dedup.drop_copies(df)
        assert kept.columns == df.columns
        assert sorted((r.doc_id, r[2]) for r in kept.collect()) == [(1, "same"), (3, "same"), (4, "same")]
