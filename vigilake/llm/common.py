"""Shared helpers of the training-data operators: tables, scratch tables, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Names of the locator columns; columns of a table that have such a name are set aside.
LOCATOR = ("locator_file", "locator_row")
#: Bits that address the bitmap of ``marked``: 16 times the keys' number, within these bounds (8 KB and 32 MB).
BITMAP_BITS = (16, 28)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table, read by Spark only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder of the session.

    A local temporary folder is used only where ``spark.checkpoint.dir`` is unset and the master is local (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vigilake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The place is added to ``paths``, for ``discard`` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more, wherever they are stored."""
    configuration = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)
    paths.clear()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same on pure ASCII and is far faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with its locator, file and row number: where the row's content is. Other inputs than files are written first.

    Columns of ``docs`` that have a locator's name are dropped; ``set_aside`` keeps them.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in LOCATOR])
    try:
        return kept.select("*", F.col("_metadata.file_path").alias(LOCATOR[0]), F.col("_metadata.row_index").alias(LOCATOR[1]))
    except AnalysisException:
        return materialize(kept, "dedup-input").select(
            "*", F.col("_metadata.file_path").alias(LOCATOR[0]), F.col("_metadata.row_index").alias(LOCATOR[1])
        )


def set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with other names for columns named as a locator, and a function that selects its columns under their own names."""
    names = []
    for c in docs.columns:
        name = c
        while name in LOCATOR or (name != c and name in (*docs.columns, *names)):
            name += "_"
        names.append(name)
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    return renamed, lambda df: df.select(*[F.col(f"`{n}`").alias(c) for c, n in zip(docs.columns, names, strict=True)])


def of_place() -> Column:
    """32 bits of a column ``place``."""
    return F.shiftrightunsigned(F.xxhash64("place"), 32)


def marked(rows: DataFrame, keys: DataFrame, n: int, of: Column) -> DataFrame:
    """``rows`` with ``listed``: false only where none of the ``n`` rows of ``keys`` has the same 32 bits ``of`` its columns."""
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], (16 * n).bit_length()))
    at = F.shiftrightunsigned(of, 32 - bits)
    bitmap = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    bit = F.bitmap_bit_position(at)
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("bit", bit).join(F.broadcast(bitmap), "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bitmap, int(bit div 8) + 1, 1)")), 16, 10).cast("int")
    there = byte.bitwiseAND(F.expr("shiftleft(1, int(bit % 8))")) != 0
    return joined.withColumn("listed", F.coalesce(there, F.lit(False))).drop("bucket", "bit", "bitmap")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of at most ``rows`` rows from here on in this session: texts can be long,
    and a worker and its executor hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]
) -> DataFrame:
    """``mapInArrow`` with one callable per task: ``make()`` runs once, its result on each batch.

    The callable gets the batch as lists by column and returns lists by output column.
    """
    spark = df.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            got = work({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)
