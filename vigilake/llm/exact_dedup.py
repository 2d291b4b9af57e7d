"""Exact deduplication over keyed streaming state, with DataFrame functions only.

1. Every row becomes an index row: SHA-256 digest of its normalised text (A-Z lower-cased), its
   stable identifier and its content locator (file and row number).
2. A stream over the index folds these into disk-backed keyed state without expiry (RocksDB,
   checkpointed in the shared folder): digest -> row that stays (largest doc_id) with its locator,
   and the number of rows. The same checkpoint can be fed with later rows.
3. On hits, full bytes are compared: texts of digests with several rows meet the text at the
   locator that the state keeps. A digest whose texts differ is split by the texts themselves.

Only texts that can be hits are shuffled: a bitmap over digest prefixes of fixed size (2 MB)
filters the scan first. Rows of one digest are joined, never gathered, so that a hot group is
split by the skew join.

Nulls: a null text is empty; null doc_ids lose against any other and may be the keep_id of a
group without others. Ties of doc_id are broken by the locator, so that one row stays. Extra
columns are ignored by ``assign`` and kept by ``drop_copies``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilake.llm.common import LOCATOR, located, lower_ascii, materialize, scratch_path, set_aside, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bits of a digest that address the bitmap of digests with several rows: 2**24 bits are 2 MB.
FILTER_BITS = 24
KEPT = " AND ".join(f"{c} = keep_{c}" for c in LOCATOR)


def normalised(text: str = "text") -> Column:
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def fold(index: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Feed the index rows at ``path`` that are new to the checkpoint into its state; return the state."""
    spark = index.sparkSession
    options = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space in advance
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else stores stay in the executors' memory after the run
    }
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(index.schema).parquet(path)
        state = stream.groupBy("digest").agg(
            F.max(F.struct("doc_id", *LOCATOR)).alias("keeper"), F.count(F.lit(1)).alias("group_size")
        )
        query = (
            state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.format("statestore").load(checkpoint)
    keeper, size = (f"value.`{f.name}`" for f in rows.schema["value"].dataType.fields)
    return rows.select(
        F.col("key.digest").alias("digest"),
        F.col(f"{keeper}.doc_id").alias("keep_id"),
        *[F.col(f"{keeper}.{c}").alias(f"keep_{c}") for c in LOCATOR],
        F.col(size).alias("group_size"),
    )


def _prefix(digest: Column, bits: int) -> Column:
    """The first ``bits`` bits of a digest as a number."""
    return F.shiftrightunsigned(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), 32 - bits)


def possible_hits(rows: DataFrame, hits: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose digest prefix is that of a digest in ``hits``: all hits and a few others."""
    at = _prefix(F.col("digest"), bits)
    bitmap = hits.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")
    )  # at most 2**(bits - 15) rows of 4 KB
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.expr("substring(bitmap, int(place div 8) + 1, 1)")), 16, 10).cast("int")
    return (
        rows.withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("place", place)
        .join(F.broadcast(bitmap), "bucket")
        .filter(byte.bitwiseAND(F.expr("shiftleft(1, int(place % 8))")) != 0)
        .drop("bucket", "place", "bitmap")
    )


def assign(docs: DataFrame, text: str = "text", digest=sha256, checkpoint: str | None = None, is_located: bool = False) -> DataFrame:
    """doc_id, locator, keep_id, group_size, kept, digest of every row of ``docs``; ``is_located``: it comes from ``located``."""
    spark = docs.sparkSession
    source = (docs if is_located else located(docs)).select("doc_id", F.col(f"`{text}`").alias("text"), *LOCATOR)
    path = scratch_path(spark, "dedup-index")
    source.select("doc_id", *LOCATOR, digest(normalised()).alias("digest")).write.parquet(path)
    index = spark.read.parquet(path)
    state = materialize(fold(index, path, checkpoint or scratch_path(spark, "dedup-state")), "dedup-keys")

    several = state.filter("group_size > 1")
    texts = source.select(*LOCATOR, normalised().alias("bytes")).withColumn("digest", digest(F.col("bytes")))
    texts = materialize(possible_hits(texts, several), "dedup-hits")
    # by locator, of which there is one each; the join by digest then stands alone, so that it can be split
    kept = several.select(*[F.col(f"keep_{c}").alias(c) for c in LOCATOR])
    first = texts.join(kept, list(LOCATOR)).select("digest", F.col("bytes").alias("first"))
    # no distinct(): it would keep the skew join from splitting a hot digest
    odd = materialize(texts.join(first, "digest").filter("bytes <> first").select("digest"), "dedup-collisions")
    out = (
        index.join(state, "digest")
        .withColumn("kept", F.expr(KEPT))
        .select("doc_id", *LOCATOR, "keep_id", "group_size", "kept", "digest")
    )
    if odd.isEmpty():
        return out
    apart = texts.join(odd, "digest", "left_semi").join(index, ["digest", *LOCATOR])
    keys = apart.groupBy("digest", "bytes").agg(
        F.max(F.struct("doc_id", *LOCATOR)).alias("keeper"), F.count(F.lit(1)).alias("group_size")
    )
    apart = apart.join(keys, ["digest", "bytes"]).select(
        "doc_id",
        *LOCATOR,
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        F.expr(" AND ".join(f"{c} = keeper.{c}" for c in LOCATOR)).alias("kept"),
        "digest",
    )
    return out.join(odd, "digest", "left_anti").select(*apart.columns).unionByName(apart)


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row with a larger doc_id has.

    All rows of a file are numbered within it, so both sides of the join see the same locators.
    """
    renamed, as_given = set_aside(docs)
    source = located(renamed)
    stay = assign(source, text, is_located=True).filter("kept").select(*LOCATOR)
    return as_given(source.join(stay, list(LOCATOR), "left_semi"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over all documents."""
    out = assign(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
