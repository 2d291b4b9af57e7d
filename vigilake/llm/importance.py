"""Importance resampling towards a target distribution, over hashed n-grams of words.

Words are runs of ASCII letters (A-Z lower-cased), digits and all bytes of other characters; features are
the runs of one and two words of a text, repeats counted, in buckets by CRC-32. Texts are read as
Arrow buffers by a byte automaton: a table puts each byte into its class, differences of classes are the
words' ends, and the CRCs of all words of a lot advance together, one byte of each word a step; a
two-word feature goes on from its first word's state.

1. Every task counts its buckets, and the counts add up to one row a bucket, for documents and target.
2. A bucket's gain is the logarithm of its shares' ratio; a document's weight is the mean gain of its features.
3. The weight with Gumbel noise by doc_id is the score; the highest scores of documents with enough words are drawn.
   Ranks are places in a range-partitioned, sorted table: place in the partition and rows before it, so that
   no task holds more than a partition.

Nulls: a null text has no words; a null doc_id counts as the empty text in the noise and comes last among equal
scores. Repeated rows count and are drawn one by one, equal ones in the order of the table. Extra columns are ignored by
``importance`` and kept by ``draw``. Any length of text is used whole; a lot is at least one text. Without features a weight is 0.
An empty table gives no rows; an empty target gives gains from the documents' counts alone.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.llm.common import LOCATOR, discard, located, materialize, set_aside, small_batches, table

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
LOT = 2_000_000  # bytes of texts that are looked at together
FEW = 16  # unfinished words that are ended one by one
_PLACES = 33  # bits of a row's place in its partition, as monotonically_increasing_id gives it


def _lookup() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased byte, whether it belongs to a word, and the CRC-32 table, by byte."""
    byte = np.arange(256)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    word = (byte >= 128) | ((lower >= 97) & (lower <= 122)) | ((byte >= 48) & (byte <= 57))
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
    return lower, word, crc


_LOWER, _WORD, _CRC = _lookup()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _advanced(state: np.ndarray, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """States after the words at ``start``: all words advance together; the last few long ones are ended one by one."""
    order = np.argsort(-length, kind="stable")
    out, start, size = state[order], start[order], length[order]
    ended = np.bincount(size)
    left, k = len(out), 0
    while left > FEW:
        left -= int(ended[k])  # those of k bytes are done
        out[:left] = _step(out[:left], raw[start[:left] + k])
        k += 1
    for i in range(left):
        rest = raw[start[i] + k : start[i] + size[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each feature, and the number of words of each text."""
    texts = pa.concat_arrays([texts]).fill_null("").cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: n + 1] if n else np.zeros(1, np.int64)
    raw = _LOWER[np.frombuffer(data, np.uint8)[: offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    word = np.zeros(len(raw) + 1, bool)
    word[:-1] = _WORD[raw]
    begins, ends = word[:-1].copy(), word[:-1].copy()
    begins[1:] &= ~word[:-2]
    ends &= ~word[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]  # a text begins and ends words whatever its neighbours are
    begins[inner] = word[inner]
    ends[inner[1:] - 1] = word[inner[1:] - 1]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    text = np.searchsorted(offsets, start, side="right") - 1
    first = _advanced(np.full(len(start), 0xFFFFFFFF, np.uint32), raw, start, length)
    pair = np.flatnonzero(text[1:] == text[:-1])
    second = _advanced(_step(first[pair], np.uint32(32)), raw, start[pair + 1], length[pair + 1])
    bucket = (np.concatenate((first, second)) ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)
    return np.concatenate((text, text[pair])), bucket.astype(np.int64), np.bincount(text, minlength=n)


def _lots(batch: pa.RecordBatch):
    """Slices of a batch of about ``LOT`` bytes of text, one text at least."""
    text = batch.column("text")
    ends = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + LOT)))
        yield batch.slice(at, to - at)
        at = to


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows; at most ``BUCKETS`` sums reach the driver."""

    def run(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for lot in _lots(b):
                n += np.bincount(features(lot.column("text"))[1], minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    n = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        n[r["bucket"]] = r["n"]
    return n


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, floored."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratio = [(t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(source: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, locator, n_words, n_features and weight of every row of a located table."""
    shared = source.sparkSession.sparkContext.broadcast(gain)
    schema = source.select("doc_id", *LOCATOR).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def run(batches):
        for b in batches:
            for lot in _lots(b):
                text, bucket, words = features(lot.column("text"))
                n = np.bincount(text, minlength=lot.num_rows)
                total = np.bincount(text, shared.value[bucket], minlength=lot.num_rows).astype(np.int64)
                cols = [pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays([*lot.columns[:-1], *cols], names=schema.names)

    small_batches(source.sparkSession)
    return source.select("doc_id", *LOCATOR, "text").mapInArrow(run, schema)


def numbered(rows: DataFrame, *order) -> tuple[DataFrame, DataFrame]:
    """``rows`` in that order with ``place``, written; and first place -> rows before it for each partition.

    A place is a partition's number and the row's place in it; the second table has a row for each partition.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "numbered")
    sizes = out.groupBy(F.shiftright("place", _PLACES).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # partitions
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["n"]
    return out, rows.sparkSession.createDataFrame(before, "part long, before long")


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, is_located: bool = False) -> DataFrame:
    """doc_id, locator, n_features, weight, score and rank (null: not drawn) of every row of ``docs`` against the ``text`` of ``target``."""
    source = (docs if is_located else located(docs)).select("doc_id", "text", *LOCATOR)
    gain = gains(bucket_counts(source), bucket_counts(target))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(name, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weights(source, gain).withColumn("score", (F.col("weight") + noise).cast("long"))
    paths: list[str] = []
    scored = materialize(scored, "scored", paths)
    enough = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), *[F.col(c) for c in LOCATOR]]
    placed, before = numbered(scored.filter(enough), *order)
    drawn = percent * placed.count() // 100
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << _PLACES) - 1)) + 1
    ranked = placed.withColumn("part", F.shiftright("place", _PLACES)).join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= drawn, rank))
    short = materialize(scored.filter(~enough), "short")
    discard(source.sparkSession, paths)
    names = ["doc_id", *LOCATOR, "n_features", "weight", "score"]
    return ranked.select(*names, "rank").unionAll(short.select(*names, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns."""
    renamed, as_given = set_aside(docs)
    source = located(renamed)
    stay = importance(source, target, percent, least_words, seed, is_located=True).filter("rank IS NOT NULL").select(*LOCATOR)
    return as_given(source.join(stay, list(LOCATOR), "left_semi"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents against all benchmark texts."""
    out = importance(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
