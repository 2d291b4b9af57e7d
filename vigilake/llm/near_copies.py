"""Near copies by word similarity: candidates from the Gray-order index of SimHash fingerprints, decided by exact similarity.

Two texts are linked if their sets of ``WORDS``-word shingles have a Jaccard similarity of ``SIMILARITY`` or more. Texts of that
similarity differ in 2 to 14 of 64 bits, too many for the few wide blocks of ``simhash.links``. So

1. texts with the same shingles become one node, with a fingerprint of ``INDEX_WORDS``-word shingles (shorter ones, whose
   fingerprints differ less between near copies);
2. each node is dealt into ``TABLES`` tables by ``BITS`` sampled bits of the fingerprint. Two fingerprints that differ in d bits
   share a group of one table at least with probability 1 - (1 - C(64-d, BITS) / C(64, BITS)) ** TABLES: over 0.999 for 3 bits,
   0.98 for 6, 0.78 for 9. A group's fingerprints are the tree of ``simhash.GrayIndex``, which tells the nodes that have a neighbour
   within ``RADIUS`` bits, of a size that allows the similarity;
3. only these get a sketch of their text, ``SKETCH`` bits of minima of its shingles' hashes (``sketches``), and are looked up again. Two texts
   of similarity s differ in (1 - s) / 2 of the bits, so neighbours that differ in more than ``MOST`` are left out: of links of just 0.8
   about one in a million, of higher ones fewer. A pair is named in the first table that it shares only;
4. every node names the neighbour of the nearest sketch in each table, and whole texts are compared, the nearest of each node first. Links
   join components (alternating stars). What is in one component is never compared again, so that a group of copies costs about as many
   comparisons as it has members;
5. the nodes are looked up again and name their neighbours of other components, ``MORE`` times as many, which are compared; those that had as
   many as they could name are looked up again, until none is left.

So every pair of different components that the tables and sketches let pass is decided. Recall is that of the tables.

Nulls: a null text is empty; texts without words are copies of each other. null doc_ids take part and stay only if a component has
no other. Repeated rows are one node. Ties of doc_id are broken by the locator. Extra columns are kept. A text is used whole, and
compared in one task with one other. An empty table gives no rows.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from vigilake.llm import simhash
from vigilake.llm.common import LOCATOR, located, marked, materialize, of_place, set_aside, small_batches

WORDS, SIMILARITY = 5, 0.8
INDEX_WORDS, RADIUS, TABLES, BITS, SEED = 2, 10, 24, 16, 11
SKETCH, MOST, MORE = 1024, 150, 2048
HELD = 200_000  # neighbours that a task holds before it keeps the nearest
BATCH, PARTITION = 4 << 20, 16 << 20
PIECE = 1 << 20  # bytes of words that are hashed together
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number with all of its bits spread over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, between ASCII white space), and how many each text has."""
    texts = pa.concat_arrays([texts]).fill_null("").cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    word = np.ones(len(raw) + 1, bool)
    word[-1] = False
    for space in (32, *range(9, 14)):
        word[:-1] &= raw != space
    begins, ends = word[:-1].copy(), word[:-1].copy()
    begins[1:] &= ~word[:-2]
    ends &= ~word[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]  # a text begins and ends words whatever its neighbours are
    begins[inner] = word[inner]
    ends[inner[1:] - 1] = word[inner[1:] - 1]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    count = np.bincount(np.searchsorted(offsets, start, side="right") - 1, minlength=n)
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):  # pieces of about a megabyte, so that a long text needs little memory
        to = max(at + 1, int(np.searchsorted(start, start[at] + PIECE)))
        s, size = start[at:to], length[at:to]
        places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        byte = raw[places + np.repeat(s, size)]
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(byte * _powers(int(size.max()))[places], np.cumsum(size) - size)
        out[at:to] = _mixed(sums + size.astype(np.uint64) * _BASE)
        at = to
    return out, count


def shingles(words: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of texts, repeats included, and how many each has; a text of fewer words is one shingle."""
    place = _powers(size + 1)[1:]
    ends = np.cumsum(count)
    room = np.repeat(ends, count) - np.arange(len(words))  # words from here to the end of the text
    out = np.zeros(len(words), np.uint64)
    for j in range(size):
        inside = len(words) - j
        out[:inside] += np.where(room[:inside] > j, words[j:] * place[j], np.uint64(0))
    short = (np.repeat(count, count) < size) & (room == np.repeat(count, count))
    keep = (room >= size) | short
    return _mixed(out[keep]), np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))


@F.arrow_udf(DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaccard similarity of the shingles of two texts; 1 if neither has any."""
    out = []
    for at in range(0, len(a), 16):
        sets = []
        for side in (a, b):
            flat, n = shingles(*word_hashes(side.slice(at, 16)), WORDS)
            sets.append([np.unique(x) for x in np.split(flat, np.cumsum(n)[:-1])])
        for x, y in zip(*sets, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            every = len(x) + len(y) - both
            out.append(both / every if every else 1.0)
    return pa.array(out, pa.float64())


def prints(source: DataFrame) -> DataFrame:
    """doc_id, locator, fingerprint, 128 bits that stand for the shingles, and their number, of every row of a located table."""
    schema = source.select("doc_id", *LOCATOR).schema
    for name, kind in (("fp", "long"), ("s1", "long"), ("s2", "long"), ("n", "integer")):
        schema = schema.add(name, kind)

    def run(batches):
        for b in batches:
            fp, whole, n, text = [np.zeros(0, np.uint64)], [], [], b.column("text")
            for lot in _lots(text):
                words, count = word_hashes(lot)
                fp.append(simhash.majority(*shingles(words, count, INDEX_WORDS)))
                flat, size = shingles(words, count, WORDS)
                for s in map(np.unique, np.split(flat, np.cumsum(size)[:-1])):
                    whole.append(xxhash.xxh3_128_digest(s.tobytes()))
                    n.append(len(s))
            s = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
            cols = [np.concatenate(fp).view(np.int64), s[:, 0], s[:, 1], np.array(n, np.int32)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, cols)], names=schema.names)

    small_batches(source.sparkSession)
    return source.select("doc_id", *LOCATOR, "text").mapInArrow(run, schema)


def _lots(texts: pa.Array):
    """Slices of about half a megabyte, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + PIECE // 2)))
        yield texts.slice(at, to - at)
        at = to


def sampled_bits() -> np.ndarray:
    """The bits that each table looks at."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(64)[:BITS] for _ in range(TABLES)]).astype(np.uint64)


def dealt(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``key``: each node in its group of every table."""
    bits, names = sampled_bits(), nodes.columns
    schema = nodes.sparkSession.createDataFrame([], "key int").schema
    for field in nodes.schema:
        schema = schema.add(field)

    def run(batches):
        for b in batches:
            fp = b.column(names.index("fp")).to_numpy().view(np.uint64)
            for t, places in enumerate(bits):
                key = np.full(len(fp), t << BITS, np.int64)
                for k, place in enumerate(places):
                    key |= ((fp >> place) & np.uint64(1)).astype(np.int64) << k
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *b.columns], names=["key", *names])

    return nodes.mapInArrow(run, schema).repartition("key").sortWithinPartitions("key")


def sketches(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row of ``SKETCH`` bits for each text: one bit of the least of its shingles' hashes under each of as many multipliers; zeros without any."""
    flat, n = shingles(words, count, WORDS)
    full = np.flatnonzero(n)
    bits = np.zeros((len(n), SKETCH), np.uint8)
    if len(full):
        starts = np.cumsum(n[full]) - n[full]
        for k, factor in enumerate(np.random.default_rng(SEED).integers(0, 1 << 63, SKETCH, dtype=np.uint64)):
            least = np.minimum.reduceat(flat * (factor << np.uint64(1) | np.uint64(1)), starts)
            bits[full, k] = (least >> np.uint64(20)) & np.uint64(1)
    return np.packbits(bits, axis=1)


def sketched(texts: DataFrame) -> DataFrame:
    """(id, sketch) of every row of (id, text)."""

    def run(batches):
        for b in batches:
            rows = [sketches(*word_hashes(lot)) for lot in _lots(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for lot in rows for x in lot], pa.binary())], names=["id", "sketch"])

    return texts.select("id", "text").mapInArrow(run, "id long, sketch binary")


def with_neighbours(nodes: DataFrame) -> DataFrame:
    """(id) of the nodes that have a neighbour in any table."""

    def run(batches):
        for key, id_, fp, n in simhash.whole_groups(batches, ["key", "id", "fp", "n"], lambda key, *_: key):
            yield pa.RecordBatch.from_arrays([pa.array(id_[near_any(key, fp.view(np.uint64), n)])], names=["id"])

    return dealt(nodes.select("id", "fp", "n")).mapInArrow(run, "id long").distinct()


def _sorted(group: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Rows in order of group and Gray rank, without those that are alone in their group."""
    order = np.lexsort((simhash.gray_rank(fp), group))
    same = group[order][1:] == group[order][:-1]
    return order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether texts of so many shingles can have the similarity."""
    return np.minimum(x, y) >= SIMILARITY * np.maximum(x, y)


def near_any(group: np.ndarray, fp: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each row has a neighbour in its group."""
    found = np.zeros(len(fp), bool)
    order = _sorted(group, fp)
    if len(order):
        size = n[order]
        for a, b in simhash.GrayIndex(group[order], fp[order]).near(RADIUS, np.arange(len(order))):
            fits = _alike(size[a], size[b])
            found[order[a[fits]]] = found[order[b[fits]]] = True
    return found


def first_shared(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the table of each group is the first that two fingerprints share; ``x``: the bits in which they differ."""
    first, table = np.ones(len(x), bool), group >> BITS
    for t, places in enumerate(sampled_bits()[:-1]):
        mask = np.bitwise_or.reduce(np.uint64(1) << places)
        first &= (table <= t) | ((x & mask) != 0)
    return first


def _apart(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits sketches differ."""
    lots = [np.bitwise_count(sketch[a[i : i + 16384]] ^ sketch[b[i : i + 16384]]).sum(1, dtype=np.int64) for i in range(0, len(a), 16384)]
    return np.concatenate(lots) if lots else np.zeros(0, np.int64)


def _nearest(a: np.ndarray, b: np.ndarray, d: np.ndarray, id_: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` nearest of each a, ties by id."""
    order = np.lexsort((id_[b], d, a))
    first = np.flatnonzero(np.concatenate(([True], a[order][1:] != a[order][:-1])))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def neighbours(group, id_, fp, n, label, again, k: int, sketch=None) -> tuple[np.ndarray, ...]:
    """(a, b, differing bits, whether a has as many as it may) of the ``k`` nearest of other labels of each node that is looked up again.

    With sketches, near is what differs in few of their bits, in ``MOST`` at most, and a pair counts in the first table that it shares.
    """
    order = _sorted(group, fp)
    order = order[again[order] | np.isin(group[order], group[order][again[order]])]  # groups that nobody asks about are left out
    group, id_, fp, n, label, again = (x[order] for x in (group, id_, fp, n, label, again))
    sketch = sketch if sketch is None else sketch[order]
    none = np.zeros(0, np.int64)
    held, most = [none, none, none], HELD
    if len(fp):
        for a, b in simhash.GrayIndex(group, fp).near(RADIUS, label):
            fits = _alike(n[a], n[b]) & (label[a] != label[b]) & (again[a] | again[b])
            if sketch is not None:
                fits &= first_shared(group[a], fp[a] ^ fp[b])
            a, b = a[fits], b[fits]
            if sketch is None:
                d = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64)
            else:
                d = _apart(sketch, a, b)
                a, b, d = (x[d <= MOST] for x in (a, b, d))
            there, back = again[a], again[b]
            found = (np.concatenate((a[there], b[back])), np.concatenate((b[there], a[back])), np.concatenate((d[there], d[back])))
            held = [np.concatenate(x) for x in zip(held, found, strict=True)]
            if len(held[0]) > most:
                held = _kept(held, id_, k)
                most = max(HELD, 2 * len(held[0]))
    a, b, d = _kept(held, id_, k)
    many = np.bincount(a, minlength=len(fp))[a] >= k if len(a) else none.astype(bool)
    return id_[a], id_[b], d, many


def _kept(held: list[np.ndarray], id_: np.ndarray, k: int) -> list[np.ndarray]:
    keep = _nearest(*held, id_, k)
    return [x[keep] for x in held]


def _once(a, b, d, many) -> list[pa.Array]:
    """Each pair once, the smaller id first: (a, b, d, whether a has as many as it may, whether b has)."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    if not len(order):
        return [pa.array(x, kind) for x, kind in (([], pa.int64()), ([], pa.int64()), ([], pa.int32()), ([], pa.bool_()), ([], pa.bool_()))]
    low, high, a, d, many = (x[order] for x in (low, high, a, d, many))
    first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
    of = [np.logical_or.reduceat(many & (a == x), first) for x in (low, high)]
    return [pa.array(low[first]), pa.array(high[first]), pa.array(d[first].astype(np.int32)), *map(pa.array, of)]


def candidates(nodes: DataFrame, k: int) -> DataFrame:
    """(a, b, d, many_a, many_b): pairs that nodes name, each once, from (id, fp, n, sketch, label, again)."""
    names = ["key", "id", "fp", "n", "label", "again", "sketch"]

    def run(batches):
        for key, id_, fp, n, label, again, sketch in simhash.whole_groups(batches, names, lambda key, *_: key):
            bits = np.frombuffer(b"".join(sketch), np.uint64).reshape(len(key), -1)
            named = neighbours(key, id_, fp.view(np.uint64), n, label, again, k, bits)
            yield pa.RecordBatch.from_arrays(_once(*named), names=["a", "b", "d", "many_a", "many_b"])

    return dealt(nodes.select(*names[1:])).mapInArrow(run, "a long, b long, d int, many_a boolean, many_b boolean")


class Components:
    """Components of nodes, as accepted links join them: (id, label) of the nodes that have a link; and all pairs that were compared."""

    def __init__(self, spark):
        self.compared = spark.createDataFrame([], "a long, b long")
        self.labels = spark.createDataFrame([], "id long, label long")

    def add(self, told: DataFrame) -> None:
        """Compared pairs (a, b, s)."""
        self.compared = self.compared.unionAll(told.select("a", "b"))
        links = told.filter(F.col("s") >= SIMILARITY).select("a", "b")
        if links.isEmpty():
            return
        # what is joined already is a star of each component, so that few rounds are left
        known = self.labels.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
        self.labels = simhash.stars(known.unionAll(links)).select(F.col("a").alias("id"), F.col("root").alias("label"))

    def label(self, rows: DataFrame, column: str, name: str = "label") -> DataFrame:
        mine = self.labels.select(F.col("id").alias(column), F.col("label").alias("_label"))
        return rows.join(mine, column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")

    def across(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) of different components that weren't compared."""
        both = self.label(self.label(pairs, "a", "_of_a"), "b", "_of_b").filter("_of_a <> _of_b").drop("_of_a", "_of_b")
        keyed = both.withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")})
        return keyed.join(self.compared.toDF("_a", "_b"), ["_a", "_b"], "left_anti").select(*pairs.columns)


def compare(pairs: DataFrame, texts: DataFrame, parts: Components) -> None:
    """Decide pairs (a, b) by their whole texts and join the components of those alike."""
    told = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    parts.add(materialize(told.select("a", "b", similarity("x", "y").alias("s")), "near-compared"))


def decide(named: DataFrame, texts: DataFrame, parts: Components, nearest: bool) -> None:
    """Compare all named pairs that are of different components; ``nearest``: each node's nearest before the others, which then may be joined."""
    if nearest:
        ways = named.select(F.explode(F.array(F.struct("a", "b", "d"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "d"))).alias("x")).select("x.*")
        first = ways.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct()
        compare(materialize(first, "near-pairs"), texts, parts)
    left = materialize(parts.across(named.select("a", "b")), "near-open")
    if not left.isEmpty():
        compare(left, texts, parts)


@contextlib.contextmanager
def few_bytes_at_once(spark: SparkSession):
    """Arrow batches of at most ``BATCH`` bytes and shuffled partitions of about ``PARTITION`` bytes, or less where the session says so:
    rows of pairs hold two texts, there can be long ones, and what is sorted is several times what was shuffled."""
    most = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH, "spark.sql.adaptive.advisoryPartitionSizeInBytes": PARTITION}
    before = {k: spark.conf.get(k, None) for k in most}
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for k, v in most.items():
        if before[k] is None or not 0 < size(before[k]) <= v:
            spark.conf.set(k, f"{v}b")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def classes(source: DataFrame) -> DataFrame:
    """doc_id, locator and label of every row of a located table: equal for rows of one component."""
    with few_bytes_at_once(source.sparkSession):  # all Python work is done in here, as its results are written
        return _classes(source)


def _classes(source: DataFrame) -> DataFrame:
    spark = source.sparkSession
    rows = materialize(prints(source), "near-prints")
    nodes = rows.groupBy("s1", "s2").agg(F.min(F.struct(F.struct(*LOCATOR).alias("place"), "fp", "n")).alias("first"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "first.*"), "near-nodes")
    known = materialize(with_neighbours(nodes), "near-known")
    places = materialize(nodes.join(known, "id", "left_semi").select("id", "place"), "near-places")
    texts = source.select(F.struct(*LOCATOR).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    texts = marked(texts, places, places.count(), of_place()).filter("listed").join(places, "place").select("id", "text")
    texts = materialize(texts, "near-texts")
    told = materialize(nodes.select("id", "fp", "n").join(sketched(texts), "id"), "near-sketches")
    parts, k, again = Components(spark), 1, known
    # nodes of one label name none, so that those that had many are looked up until no other label is near
    while not again.isEmpty():
        asked = parts.label(told, "id").join(again.withColumn("again", F.lit(True)), "id", "left").withColumn("again", F.col("again").isNotNull())
        named = materialize(candidates(asked, k), "near-candidates")
        decide(named, texts, parts, nearest=k == 1)
        many = F.explode(F.filter(F.array(F.when(F.col("many_a"), F.col("a")), F.when(F.col("many_b"), F.col("b"))), lambda x: x.isNotNull()))
        again = materialize(named.select(many.alias("id")).distinct(), "near-again")
        k *= MORE
    labelled = parts.label(nodes.select("id", "s1", "s2"), "id")
    ids = materialize(labelled.select("s1", "s2", "label"), "near-labels")
    return rows.join(ids, ["s1", "s2"]).select("doc_id", *LOCATOR, "label")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row, of the smallest doc_id, of each component."""
    renamed, as_given = set_aside(docs)
    source = located(renamed)
    rows = materialize(classes(source.select("doc_id", "text", *LOCATOR)), "near-rows")
    stay = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *LOCATOR)).alias("stay"))
    stay = stay.select(*[F.col(f"stay.{c}").alias(c) for c in LOCATOR])
    gone = materialize(rows.join(stay, list(LOCATOR), "left_anti").select(F.struct(*LOCATOR).alias("place")), "near-gone")
    # few texts go, so only what has the bits of one that goes is moved; columns are packed, as they may have any names
    own = F.struct(*[F.col(f"`{c}`") for c in source.columns if c not in LOCATOR]).alias("row")
    told = marked(source.select(own, F.struct(*LOCATOR).alias("place")), gone, gone.count(), of_place())
    left = told.filter("listed").join(gone, "place", "left_anti").select("row")
    return as_given(told.filter("not listed").select("row").unionAll(left).select("row.*"))
