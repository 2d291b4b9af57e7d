"""Fill-in-the-middle: an index of distinct texts with their unit boundaries, and seeded cuts.

Units: white space before a run of other characters with that run; white space at the end of a text
is a unit of its own. A boundary list holds the ends of a text's units in code points, as an
Elias-Fano code: low bits packed, high bits in unary, selected by counting bits.

1. A row becomes SHA-256 digest and locator. Digests of several rows are the groups of identical texts.
2. Rows whose digest is in no group (a bitmap of the groups' digests, broadcast, of at most 32 MB, says so)
   are distinct texts whose list serves themselves: listed and cut where they are read, without a shuffle.
3. For the others, the first row of a group (found by another such bitmap, of places, before the exact join) puts its
   text and its boundary list into the index, once for all its copies. Documents are joined to it by digest, and a copy is taken for one only if its whole
   text equals the indexed one. A text that isn't (equal digests) gets a list of its own.
   A hot group meets one row of the index, so the skew join can split it.
4. Two units are selected by hashes of the seed and doc_id, and the text is put together in the JVM.

Nulls: a null text is empty: no units, form plain. A null doc_id counts as the empty text in the hash.
Repeated rows are cut alike. Ties don't arise: a group's first row is the one with the smallest locator, and
any of equal texts gives the same list. Extra columns are ignored. Any length of text is used whole; a text,
its bytes' marks and its list are held by one task. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from vigilake.llm.common import LOCATOR, located, marked, materialize, of_place, small_batches, table

SEED = 42
PLAIN_SHARE, SPM_SHARE = 50, 80  # h3 % 100 below: cut; h4 % 100 below: suffix first
MARKS = ["<P>", "<S>", "<M>"]
LIST = StructType().add("n", "long").add("n_chars", "long").add("low_bits", "integer").add("lower", "binary").add("upper", "binary")
CUT = StructType().add("prefix", "long").add("middle", "long")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Ends of the units of one text (UTF-8), in code points."""
    if not len(raw):
        return np.zeros(0, np.int64)
    visible = ~_SPACE[raw]
    last = visible.copy()
    last[:-1] &= ~visible[1:]
    points = np.cumsum((raw & 0xC0) != 0x80)
    ends = points[last]
    return ends if visible[-1] else np.append(ends, points[-1])


def encode(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """Elias-Fano code of a rising list: number of low bits, low bits, high bits."""
    n = len(ends)
    if not n:
        return 0, b"", b""
    low = max(0, (int(ends[-1]) // n).bit_length() - 1)
    bits = (ends[:, None] >> np.arange(low)) & 1
    upper = np.zeros((int(ends[-1]) >> low) + n, np.uint8)
    upper[(ends >> low) + np.arange(n)] = 1
    return low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes()


def select(i: int, low: int, lower: bytes, upper: bytes) -> int:
    """The i-th entry (from 0) of an Elias-Fano code."""
    bits = np.frombuffer(upper, np.uint8)
    ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
    byte = int(np.searchsorted(ones, i + 1))
    inside = i - int(ones[byte - 1] if byte else 0)
    at = 8 * byte + int(np.flatnonzero(np.unpackbits(bits[byte : byte + 1], bitorder="little"))[inside])
    first = i * low
    chunk = int.from_bytes(lower[first // 8 : (first + low + 7) // 8], "little") >> (first % 8)
    return ((at - i) << low) | (chunk & ((1 << low) - 1))


@F.arrow_udf(LIST)
def boundary_list(text: pa.Array) -> pa.Array:
    """Boundary lists of texts; null of null."""
    n, chars, low, lower, upper = [], [], [], [], []
    for t in text:
        if not t.is_valid:
            got, size = (0, b"", b""), 0
            n.append(None)
        else:
            ends = unit_ends(np.frombuffer(t.as_buffer(), np.uint8))
            got, size = encode(ends), int(ends[-1]) if len(ends) else 0
            n.append(len(ends))
        chars.append(size)
        for out, x in zip((low, lower, upper), got, strict=True):
            out.append(x)
    cols = [pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(low, pa.int32()), pa.array(lower, pa.binary()), pa.array(upper, pa.binary())]
    return pa.StructArray.from_arrays(cols, ["n", "n_chars", "low_bits", "lower", "upper"], mask=pa.array([x is None for x in n], pa.bool_()))


@F.arrow_udf(CUT)
def selected(low: pa.Array, lower: pa.Array, upper: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Code points of a text's first ``first`` units, and of its first ``second``."""
    out = [
        [select(i - 1, b, lo.as_py(), up.as_py()) if i else 0 for i in (p, m)]
        for b, lo, up, p, m in zip(low.to_pylist(), lower, upper, first.to_pylist(), second.to_pylist(), strict=True)
    ]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["prefix", "middle"])


def of_digest() -> Column:
    """32 bits of a digest."""
    return F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")


def listed(docs: DataFrame, digest=lambda t: F.unhex(F.sha2(t.cast("binary"), 256))) -> DataFrame:
    """doc_id, text (null as empty) and boundary list of every row: one list is made for each distinct text."""
    spark = docs.sparkSession
    small_batches(spark)
    source = located(docs)
    rows = source.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *LOCATOR)
    keys = rows.select(digest(F.col("text")).alias("digest"), F.struct(*LOCATOR).alias("place"))
    groups = keys.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = materialize(groups.select("digest", F.col("first").alias("place")), "fim-groups")
    n = groups.count()
    split = marked(rows.withColumn("digest", digest(F.col("text"))), groups, n, of_digest())
    alone = split.filter("NOT listed").select("doc_id", "text", boundary_list("text").alias("list"))

    copies = materialize(split.filter("listed").select("doc_id", "text", "digest", F.struct(*LOCATOR).alias("place")), "fim-copies")
    # the same again, so that of a group's texts only its first one moves to its row of the index
    firsts = marked(copies, groups, n, of_place()).filter("listed").join(groups, ["digest", "place"])
    index = materialize(firsts.select("digest", F.col("text").alias("indexed"), boundary_list("text").alias("index")), "fim-index")
    joined = copies.join(index, "digest", "left").withColumn("same", F.coalesce(F.col("text") == F.col("indexed"), F.lit(False)))
    own = boundary_list(F.when(~F.col("same"), F.col("text")))
    return alone.unionAll(joined.select("doc_id", "text", F.when(F.col("same"), F.col("index")).otherwise(own).alias("list")))


def transform(docs: DataFrame, seed: int = SEED, digest=None) -> DataFrame:
    """doc_id, text, n, form (plain, psm, spm), prefix_chars, middle_chars and output of every row."""
    rows = listed(docs, digest) if digest else listed(docs)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(name, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    n = F.col("list.n")
    has_mark = F.lit(False)
    for m in MARKS:
        has_mark = has_mark | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | has_mark | (h[2] % 100 >= PLAIN_SHARE), "plain").when(h[3] % 100 < SPM_SHARE, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "list", form.alias("form"), (h[0] % (n + 1)).alias("a"), (h[1] % (n + 1)).alias("b"))
    cut = selected("list.low_bits", "list.lower", "list.upper", F.least("a", "b"), F.greatest("a", "b"))
    rows = rows.select("doc_id", "text", F.col("list.n").alias("n"), "form", cut.alias("cut"))
    part = {
        "P": F.expr("substring(text, 1, int(cut.prefix))"),
        "M": F.expr("substring(text, int(cut.prefix) + 1, int(cut.middle - cut.prefix))"),
        "S": F.expr("substring(text, int(cut.middle) + 1)"),
    }
    ordered = lambda names: F.concat(*[x for k in names for x in (F.lit(f"<{k}>"), part[k])])
    cut_up = F.col("form") != "plain"
    return rows.select(
        "doc_id",
        "text",
        "n",
        "form",
        F.when(cut_up, F.col("cut.prefix")).alias("prefix_chars"),
        F.when(cut_up, F.col("cut.middle") - F.col("cut.prefix")).alias("middle_chars"),
        F.when(F.col("form") == "psm", ordered("PSM")).when(F.col("form") == "spm", ordered("SPM")).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A cut text holds no mark, and no mark ends as another begins, so each is found once."""
    part = F.split(output, "<[PSM]>", -1)
    of = lambda *places: F.concat(*[F.get(part, F.lit(k)) for k in places])
    return F.when(form == "psm", of(1, 3, 2)).when(form == "spm", of(2, 3, 1)).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11 over all documents."""
    out = transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
