"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: A-Z lower-cased, words between ASCII white space, k-word shingles with repeats
(fewer words: the whole sequence; none: fingerprint zero), XXH64 with seed 42; a bit is set where
over half of the hashes have it.

Links (``differing`` bits or fewer): 64 bits are cut into ``differing + 1`` blocks, and any two
linked fingerprints agree in one. Distinct fingerprints are dealt by (block, its value). Inside
such a group they are sorted by Gray rank, and runs of neighbours become the nodes of a tree:
a node keeps the bits that all of its fingerprints share (mask and pattern). The tree is joined
with itself from the root down; a pair of nodes whose shared bits already differ in too many
places is dropped with everything below, as is a pair inside one known component. A group gives
a forest that spans its components, not all of its pairs, so thousands of close copies cost no
more rows than they are. Components are then joined by alternating large and small stars.

Nulls: a null text is empty; null doc_ids take part, and a component of nulls only has a null
id. Repeated rows share a fingerprint and a component. Extra columns are ignored by ``classes``
and kept by ``drop_near_copies``. Any length of text is used whole. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.llm.bpe import in_small_lots
from vigilake.llm.common import LOCATOR, discard, located, materialize, set_aside, small_batches, table

SHINGLE, DIFFERING, SEED = 3, 3, 42
LEAF, FAN = 16, 8  # fingerprints of a leaf, children of an upper node
GROUP_ROWS, PAIRS = 65_536, 262_144  # rows of whole groups that are joined at once; pairs that are compared at once


def hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return [digest(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprints_of(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """Fingerprints as unsigned 64-bit numbers."""
    each = [hashes(t, size) for t in texts]
    return majority(np.array([x for h in each for x in h], "<u8"), np.array([len(h) for h in each], np.int64))


def majority(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of ``n[i]`` hashes: the bits that over half of them have; zero without any."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(n[full]) - n[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = (2 * ones > n[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, locator and fp (the fingerprint's bits as a long) of every row."""
    schema = docs.select("doc_id", *LOCATOR).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.names.index("text")).to_pylist()
            fp = [fingerprints_of(lot, size) for lot in in_small_lots(texts, 500_000)]
            fp = np.concatenate(fp).view(np.int64) if fp else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=schema.names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", *LOCATOR, "text").mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the sequence of Gray codes."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _runs(group: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of at most ``size`` neighbours of one group (``group`` is sorted)."""
    at = np.arange(len(group))
    first = np.concatenate(([True], group[1:] != group[:-1]))
    inside = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.flatnonzero(inside % size == 0)


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; every parent is smaller than its child."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        other = a != b
        a, b = a[other], b[other]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


class GrayIndex:
    """The tree over sorted (group, Gray rank); level 0 holds the fingerprints themselves."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.starts, self.both, self.any = [], [fp], [fp]
        size = LEAF
        while True:
            starts = _runs(group, size)
            self.starts.append(np.append(starts, len(group)))
            self.both.append(np.bitwise_and.reduceat(self.both[-1], starts))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], starts))
            group, size = group[starts], FAN
            if len(np.unique(group)) == len(group):
                break

    def _below(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of the node pairs (a, b), each unordered pair once."""
        s = self.starts[level - 1]
        na, nb = s[a + 1] - s[a], s[b + 1] - s[b]
        n = na * nb
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        nb = np.repeat(nb, n)
        x, y = np.repeat(s[a], n) + k // nb, np.repeat(s[b], n) + k % nb
        keep = (x <= y) if level > 1 else (x < y)
        return x[keep], y[keep]

    def near(self, most: int, label: np.ndarray):
        """Lots of pairs within ``most`` differing bits whose labels differ; nodes of one label are dropped with all below."""
        low, high = [label], [label]
        for s in self.starts:
            low.append(np.minimum.reduceat(low[-1], s[:-1]))
            high.append(np.maximum.reduceat(high[-1], s[:-1]))
        top = len(self.starts)
        root = np.arange(len(self.both[top]))
        todo = [(top, root, root)]
        while todo:
            level, a, b = todo.pop()
            s = self.starts[level - 1]
            cost = np.cumsum((s[a + 1] - s[a]) * (s[b + 1] - s[b]))
            if len(a) > 1 and cost[-1] > PAIRS:
                half = max(1, int(np.searchsorted(cost, cost[-1] // 2)))
                todo += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            a, b = self._below(level, a, b)
            level -= 1
            shared = ~(self.both[level][a] ^ self.any[level][a]) & ~(self.both[level][b] ^ self.any[level][b])
            differ = np.bitwise_count((self.both[level][a] ^ self.both[level][b]) & shared)
            known = (low[level][a] == high[level][a]) & (low[level][a] == low[level][b]) & (low[level][b] == high[level][b])
            keep = (differ <= most) & ~known
            a, b = a[keep], b[keep]
            if len(a):
                if level:
                    todo.append((level, a, b))
                else:
                    yield a, b

    def components(self, most: int) -> np.ndarray:
        """Smallest member of each fingerprint's component under ``most`` differing bits."""
        fp, n = self.both[0], len(self.both[0])
        parent = np.arange(n)
        for d in range(1, min(5, n)):  # neighbours in Gray order are mostly linked where any are
            near = np.flatnonzero(np.bitwise_count(fp[d:] ^ fp[:-d]) <= most)
            _unite(parent, near, near + d)
        for a, b in self.near(most, _roots(parent, np.arange(n))):
            _unite(parent, a, b)
        return _roots(parent, np.arange(n))


def forest(group: np.ndarray, fp: np.ndarray, most: int = DIFFERING) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, another of its component) that span the components inside each group."""
    order = np.lexsort((gray_rank(fp), group))
    group, fp = group[order], fp[order]
    several = np.flatnonzero(np.concatenate(([False], group[1:] == group[:-1])) | np.concatenate((group[1:] == group[:-1], [False])))
    group, fp = group[several], fp[several]
    if not len(fp):
        return fp, fp
    root = GrayIndex(group, fp).components(most)
    tied = np.flatnonzero(root != np.arange(len(root)))
    return fp[tied], fp[root[tied]]


def whole_groups(batches, names: list[str], key):
    """Columns of lots of whole groups, of about ``GROUP_ROWS`` rows, from batches that are sorted by ``key`` of the columns."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        columns = [b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in names]
        group = key(*columns)
        held.append(columns)
        rows += b.num_rows
        if rows >= GROUP_ROWS and group[0] != group[-1]:  # all but the last group are whole
            cut = int(np.searchsorted(group, group[-1]))
            held[-1] = [c[:cut] for c in columns]
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, rows = [[c[cut:] for c in columns]], b.num_rows - cut
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def links(prints: DataFrame, most: int = DIFFERING) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span all components of links."""
    width = 64 // (most + 1)
    blocks = prints.select(
        "fp", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("block")
    ).withColumn("value", F.expr(f"shiftrightunsigned(fp, int(block * {width})) & {(1 << width) - 1}L"))
    dealt = blocks.repartition("block", "value").sortWithinPartitions("block", "value")

    def run(batches):
        for block, value, fp in whole_groups(batches, ["block", "value", "fp"], lambda block, value, _: block.astype(np.int64) << 48 | value):
            a, b = forest(block.astype(np.int64) << 48 | value, fp.view(np.uint64), most)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.select("block", "value", "fp").mapInArrow(run, "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """(a, root): the smallest number of each component, by alternating large and small stars."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    paths: list[str] = []
    edges = materialize(edges.distinct(), "links", paths)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(small.unionAll(low.select("a", F.col("low").alias("b"))).distinct(), "links", paths)
        discard(edges.sparkSession, paths[:-1])
        now = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(38)))")).first()
        if now == before:
            return edges.withColumnRenamed("b", "root")
        before = now


def classes(docs: DataFrame, size: int = SHINGLE, most: int = DIFFERING, is_located: bool = False) -> DataFrame:
    """doc_id, locator, fp and component_id (smallest doc_id of the component) of every row; ``is_located``: ``docs`` comes from ``located``."""
    rows = materialize(fingerprints(docs if is_located else located(docs), size), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = stars(links(prints, most))
    named = materialize(
        prints.join(roots, prints.fp == roots.a, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots"
    )
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # written, so that nothing but exchanges stands below the join of all rows, which then can be split
    ids = materialize(named.join(ids, "root").select("fp", "component_id"), "components")
    return rows.join(ids, "fp").select("doc_id", *LOCATOR, "fp", "component_id")


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, most: int = DIFFERING) -> DataFrame:
    """``docs`` with one row, of the smallest doc_id, of each component."""
    renamed, as_given = set_aside(docs)
    source = located(renamed)
    rows = materialize(classes(source, size, most, is_located=True), "classes")
    keys = rows.withColumn("known", F.col("component_id").isNotNull())
    stay = keys.groupBy("component_id", F.when(~F.col("known"), F.col("fp")).alias("alone")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *LOCATOR)).alias("stay")
    )
    stay = stay.select(*[F.col(f"stay.{c}").alias(c) for c in LOCATOR])
    return as_given(source.join(stay, list(LOCATOR), "left_semi"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over all documents."""
    out = classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
