"""Line deduplication by range-partitioned hashes, with DataFrame functions only.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A line is dropped
where its key has at least ``LEAST`` code points and an earlier document (smaller doc_id) holds it.

1. Every line with such a key becomes a row of fixed size: two hashes of the key (128 bits), doc_id,
   file, row and position. Texts don't travel; the rows are written once and read by the steps below.
2. Hashes that hold a large share of all lines are found by sketches, which are merged in two steps.
   They are ``HOT`` at most. The first document of each comes from a pre-aggregated minimum and is
   broadcast, so that their lines are decided where they are read, without any shuffle.
3. All other hashes are range-partitioned and sorted by document and position within; the first row
   of a hash passes its document on to the rows after it.
4. Dropped positions become a bitmap for each document: words of 64 lines, of which only those with a
   dropped line are kept (all other lines stay).

The result of ``keep_bitmaps`` is these, not texts; ``drop_lines`` and the query apply them.

Nulls: a null text is one empty line. Rows with a null doc_id are taken as one document after all
others. Rows of one doc_id are one document, so that its repeated rows lose nothing to each other; a line
that is repeated inside its first document stays there as often. Extra columns are ignored by
``keep_bitmaps`` and kept by ``drop_lines``, whatever their names. Any length of text is used whole.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigilake.llm.common import LOCATOR, located, lower_ascii, materialize, set_aside, table

LEAST = 10
SPACE = " \t\n\x0b\x0c\r"
#: Hashes that are decided without a shuffle; those that a sketch follows (it finds all with 3.5 of that many parts of the lines).
HOT, TRACKED = 1024, 8192
#: A hash is hot if it has this part of all lines or more.
HOT_SHARE = 1 / 4096
HASH = ["h1", "h2"]
PLACE = ["file", "row"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def place_of() -> list[Column]:
    """Where a row is, in numbers: a hash of its file's name (there are far fewer than 2**32 files) and its row in it."""
    return [F.xxhash64(LOCATOR[0]).alias(PLACE[0]), F.col(LOCATOR[1]).alias(PLACE[1])]


def line_hashes(source: DataFrame) -> DataFrame:
    """One row for each line with a key of at least ``LEAST`` code points, from located (doc_id, text)."""
    lines = source.select("doc_id", *place_of(), F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    keys = lines.withColumn("key", F.btrim("line", F.lit(SPACE))).filter(F.char_length("key") >= LEAST).withColumn("key", lower_ascii(F.col("key")))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", *PLACE, "at")


def hot_hashes(lines: DataFrame) -> DataFrame:
    """h1 of at most ``HOT`` hashes that have ``HOT_SHARE`` of all lines or more, by sketches of bounded size."""
    part = lines.groupBy(F.pmod(F.spark_partition_id(), F.lit(256)).alias("part")).agg(
        F.call_function("approx_top_k_accumulate", F.col("h1"), F.lit(TRACKED)).alias("sketch"), F.count(F.lit(1)).alias("n")
    )
    all_ = part.groupBy((F.col("part") * 0).alias("all")).agg(F.call_function("approx_top_k_combine", F.col("sketch"), F.lit(TRACKED)).alias("sketch"), F.sum("n").alias("n"))
    top = all_.select("n", F.explode(F.call_function("approx_top_k_estimate", F.col("sketch"), F.lit(HOT))).alias("top"))
    return top.filter(F.col("top.count") >= F.col("n") * HOT_SHARE).select(F.col("top.item").alias("h1"))


def dropped(lines: DataFrame) -> DataFrame:
    """(file, row, at) of each line whose hash is in an earlier document."""
    hot = F.broadcast(hot_hashes(lines))  # HOT rows at most
    firsts = lines.join(hot, "h1").groupBy(*HASH).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"))
    firsts = materialize(firsts, "hot-lines")  # as many, but for equal h1
    later = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    decided = lines.join(F.broadcast(firsts), HASH).filter(later).select(*PLACE, "at")

    rest = lines.join(F.broadcast(firsts.select(*HASH)), HASH, "left_anti")
    order = [F.col("doc_id").asc_nulls_last(), *PLACE, "at"]
    sorted_ = rest.repartitionByRange(*HASH).sortWithinPartitions(*HASH, *order)
    first = F.first_value("doc_id").over(Window.partitionBy(*HASH).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    streamed = sorted_.withColumn("first", first).filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select(*PLACE, "at")
    return decided.unionAll(streamed)


def keep_bitmaps(docs: DataFrame, is_located: bool = False) -> DataFrame:
    """file, row, n_dropped and keep of each row that loses lines: words of 64 lines that lose some, bit set where a line stays."""
    source = docs if is_located else located(docs)
    lines = materialize(line_hashes(source.select("doc_id", "text", *LOCATOR)), "line-hashes")
    words = dropped(lines).groupBy(*PLACE, F.expr("int(at div 64)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("gone")
    )
    return words.groupBy(*PLACE).agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
    )


def with_kept(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``rows`` (text, file, row) with n_lines, n_dropped and kept, the text without dropped lines."""
    # spelled out on the side of the bitmaps, so that it is done once for a document and not for each line
    gap = "x.word - 1 - if(i = 0, -1, keep[i - 1].word)"
    full = F.expr(f"flatten(transform(keep, (x, i) -> concat(array_repeat(-1L, {gap}), array(x.bits))))")
    bitmaps = bitmaps.select(*PLACE, "n_dropped", full.alias("full"))
    lines = split_lines(F.col("text"))
    kept = F.expr(
        r"array_join(filter(split(coalesce(text, ''), '\n', -1), (x, i) -> (shiftrightunsigned(coalesce(get(full, int(i div 64)), -1L), int(i % 64)) & 1L) = 1L), '\n')"
    )
    return rows.join(bitmaps, PLACE, "left").select(
        *rows.columns,
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("full").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with their texts without dropped lines."""
    renamed, as_given = set_aside(docs)
    source = located(renamed)
    rows = source.select(F.struct(*[F.col(f"`{c}`") for c in renamed.columns]).alias("given"), F.col("text").alias("text"), *place_of())
    out = with_kept(rows, keep_bitmaps(source, is_located=True)).select(F.col("given").withField("text", F.col("kept")).alias("given"))
    return as_given(out.select("given.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over all documents."""
    source = located(table(spark, sf_dir, "documents", "doc_id", "text"))
    out = with_kept(source.select("doc_id", "text", *place_of()), keep_bitmaps(source, is_located=True))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT r, doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(first = doc_id, true) AS stays FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY r
"""
