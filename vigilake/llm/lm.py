"""Language-model scores by online logistic context mixing.

Jobs, each over all documents or over the table of distinct words, none of it gathered:

1. Bytes and successions of short words of the training documents give a prefix code for bytes
   and a few classes of text (languages, in effect), by a mixture model over at most 65,536 counts.
   The class of a place follows from the short words before it, so it is known to a decoder.
2. Words are counted by class, training rows apart: one row for each distinct word.
3. Bit counts by hashed context are summed over the training words, into tables that grow with their number.
4. Mixing weights and the refining map are learned online, in shards by the words' hash, each in
   the order of its words, and averaged as whole numbers: scores don't depend on partitions.
5. Each distinct (class, word) gets its log probability once.
6. Documents add up their words. Words with at least one in ``2**HEAVY`` of all tokens are at
   most ``2**HEAVY`` and are looked up in a broadcast table; all others, none of which can be
   frequent, are joined. The same rows give the base score from exact counts.

Nulls: a null text is empty and has the end token only; a null doc_id is carried and counts as
empty text for the fold. Repeated rows are scored and trained on one by one. Extra columns are
ignored. Without training rows all bits have even odds. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilake.llm import mixing
from vigilake.llm.common import crc_mod, discard, materialize, small_batches, table

FOLDS, HELD_OUT = 5, 1
CLASSES, SHORT, BUCKETS = 6, 3, 256  # classes of text; bytes of a short word; hashed short words
HEAVY = 20
FLUSH = 300_000  # distinct words that a task counts before it hands them on
CHUNK = 8192  # slots of a table that travel together
SHARD, LEARN_SHARD = 2_000_000, 500_000  # distinct words that one task counts bits of, and learns weights from
LOT, STEP = 8_192, 2_048  # words that are looked up at once, and of an online step
LOT_BYTES, BLOCK_BYTES = 1 << 20, 1 << 25  # bytes at which a lot, and a block of the table of words, ends early
FIXED = 1 << 20  # weights are averaged as whole numbers of this part, so that no order of sums shows
LOG2 = float(np.log10(2))


def _data(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large array of strings that starts its buffers."""
    if strings.offset:
        strings = pa.concat_arrays([strings])
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[: len(strings) + 1]
    return offsets, np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)


def is_held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, FOLDS) == HELD_OUT


class Words:
    """The words of a lot of texts, with their documents and short-word buckets; ends of texts are kept apart."""

    def __init__(self, texts: pa.Array | list[str | None]):
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        # one of its own buffers: the cast of a slice keeps offsets that don't start at 0, which ascii_lower takes wrongly
        lower = pc.ascii_lower(pa.concat_arrays([texts]).fill_null("").cast(pa.large_string()))
        self.bytes = pc.binary_length(lower).to_numpy()
        self.raw = _data(lower)[1]
        split = pc.ascii_split_whitespace(lower)
        words = split.flatten().cast(pa.large_binary())
        doc = np.repeat(np.arange(len(lower)), np.diff(split.offsets.to_numpy()))
        there = pc.greater(pc.binary_length(words), 0)
        self.words = words.filter(there)
        self.doc = doc[there.to_numpy(zero_copy_only=False)]
        self.first = np.searchsorted(self.doc, np.arange(len(lower) + 1))  # first word of each document
        offsets, data = _data(self.words)
        size = np.diff(offsets)
        self.short = np.flatnonzero(size <= SHORT)
        at, size = offsets[:-1][self.short], size[self.short]
        value = np.zeros(len(at), np.uint64)
        for k in range(SHORT):
            value += np.where(size > k, data[np.minimum(at + k, max(len(data) - 1, 0))].astype(np.uint64) + np.uint64(1), np.uint64(0)) << np.uint64(8 * k)
        with np.errstate(over="ignore"):
            self.bucket = ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)

    def coded(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, and the number of each word among them."""
        coded = self.words.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def classes(self, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word's place, and of each document's end, from the short words before."""
        seen = np.zeros(len(self.words) + 1, np.int64)
        seen[self.short + 1] = 1
        seen = np.cumsum(seen)  # short words before word i, in the lot
        total = np.vstack([np.zeros((1, model.shape[1])), np.cumsum(model[1 + self.bucket], axis=0)])
        base = seen[self.first]  # at each document's start
        mine = self.doc[self.short] if len(self.short) else np.zeros(0, np.int64)
        after = np.argmax(model[0] + total[1:] - total[base[mine]], axis=1) if len(mine) else np.zeros(0, np.int64)
        after = np.concatenate(([int(np.argmax(model[0]))], after))
        inside = lambda i, d: np.where(seen[i] > base[d], after[seen[i]], after[0])
        docs = np.arange(len(self.bytes))
        return inside(np.arange(len(self.words)), self.doc), inside(self.first[1:], docs)


def class_model(pairs: np.ndarray, seed: int = 3) -> np.ndarray:
    """Row 0: log share of each class; row 1 + b: log probability of bucket b in it. By expectation maximisation."""
    share, theta, best = np.full(CLASSES, 1 / CLASSES), np.full((CLASSES, BUCKETS), 1 / BUCKETS), -np.inf
    pairs = pairs + pairs.T
    if pairs.sum():
        for restart in range(4):
            rng = np.random.default_rng(seed + restart)
            s, t = np.full(CLASSES, 1 / CLASSES), rng.dirichlet(np.ones(BUCKETS), CLASSES)
            for _ in range(80):
                joint = s[:, None, None] * t[:, :, None] * t[:, None, :]
                whole = joint.sum(axis=0) + 1e-300
                part = joint * (pairs / whole)
                s = part.sum(axis=(1, 2)) / pairs.sum()
                t = part.sum(axis=2) + 1e-9
                t /= t.sum(axis=1, keepdims=True)
            fit = float((pairs * np.log(whole)).sum())
            if fit > best:
                share, theta, best = s, t, fit
    theta = 0.98 * theta + 0.02 / BUCKETS
    return np.log(np.vstack([share + 1e-9, theta.T]))


def _arrow(df: DataFrame, run, schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _lots(batches, lot: int = 2_000_000):
    """Batches of about ``lot`` bytes of text, cut and joined from those given."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False) + 1)
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = min(b.num_rows, int(np.searchsorted(ends, done + lot - size)) + 1)
            held.append(b.slice(at, to - at))
            size += int(ends[to - 1]) - done
            at = to
            if size >= lot:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def survey(docs: DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The classes' model and the bytes' prefix code, from all training documents."""

    def run(batches):
        n = np.zeros(BUCKETS * BUCKETS + 256, np.int64)
        for lot in _lots(batches):
            w = Words(lot.column("text"))
            doc = w.doc[w.short]
            together = doc[1:] == doc[:-1]
            n[:-256] += np.bincount(w.bucket[:-1][together] * BUCKETS + w.bucket[1:][together], minlength=BUCKETS * BUCKETS)
            bytes_ = np.bincount(w.raw, minlength=256)
            bytes_[[9, 10, 11, 12, 13]] = 0
            bytes_[mixing.END] = len(w.words) + lot.num_rows
            n[-256:] += bytes_
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    n = np.zeros(BUCKETS * BUCKETS + 256)
    rows = _arrow(docs.filter("NOT held_out").select("text"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most as many rows as cells
        n[r["at"]] = r["n"]
    return class_model(n[:-256].reshape(BUCKETS, BUCKETS)), mixing.prefix_code(n[-256:])


def count_words(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """word, and by class k: c{k} of training tokens and n{k} of all tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            out = pa.concat_tables(held).group_by(["word", "k"], use_threads=False).aggregate([("c", "sum"), ("n", "sum")])
            return out.select(["word", "k", "c_sum", "n_sum"]).rename_columns(["word", "k", "c", "n"])

        for lot in _lots(batches):
            w = Words(lot.column("text"))
            inside, end = w.classes(shared.value)
            out = lot.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64)
            distinct, code = w.coded()
            key, n = np.unique((code * CLASSES + inside) * 2 + out[w.doc], return_counts=True)
            ends, m = np.unique(end * 2 + out, return_counts=True)
            words = pa.concat_arrays([distinct.take(pa.array(key // (2 * CLASSES))), pa.array([b""] * len(ends), pa.large_binary())])
            key, n = np.concatenate((key, ends)), np.concatenate((n, m))
            held.append(pa.table([words.cast(pa.binary()), pa.array((key // 2 % CLASSES).astype(np.int32)), pa.array(np.where(key % 2, 0, n)), pa.array(n)], names=["word", "k", "c", "n"]))
            if sum(t.num_rows for t in held) > 2 * FLUSH:
                held = [summed()]
                if held[0].num_rows > FLUSH:
                    yield from held[0].to_batches(max_chunksize=65_536)
                    held = []
        if held:
            yield from summed().to_batches(max_chunksize=65_536)

    got = _arrow(docs.select("held_out", "text"), run, "word binary, k int, c long, n long")
    sums = [F.sum(F.when(F.col("k") == k, F.col(v)).otherwise(0)).alias(f"{v}{k}") for v in "cn" for k in range(CLASSES)]
    return got.groupBy("word").agg(*sums)


def sharded(words: DataFrame, shards: int) -> DataFrame:
    """Words dealt to a number of shards by hash and sorted in each, however many partitions there are."""
    return words.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "word")


def _blocks(batches, rows: int = 65_536):
    """(shard, block) of the table of words: of one shard, of ``rows`` rows or BLOCK_BYTES of words, whatever the batches were."""
    held, count, size, now = [], 0, 0, None

    def block():
        return now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        shard = b.column("shard").to_numpy() if "shard" in b.schema.names else np.zeros(b.num_rows, np.int32)
        ends = np.cumsum(pc.binary_length(b.column("word")).to_numpy())
        at = 0
        while at < b.num_rows:
            if count and (shard[at] != now or count >= rows or size >= BLOCK_BYTES):
                yield block()
                held, count, size = [], 0, 0
            now, done = shard[at], int(ends[at - 1]) if at else 0
            to = min(b.num_rows, at + rows - count, int(np.searchsorted(shard, now, side="right")), int(np.searchsorted(ends, done + BLOCK_BYTES - size)) + 1)
            held.append(b.slice(at, to - at))
            count, size, at = count + to - at, size + int(ends[to - 1]) - done, to
    if count:
        yield block()


def _by_class(batch: pa.RecordBatch, count: str, lot: int = LOT):
    """(rows, words, classes, counts) of a block of the table of words, lot by lot of few words and bytes."""
    words = batch.column("word").to_numpy(zero_copy_only=False)
    length = pc.binary_length(batch.column("word")).to_numpy().astype(np.int64) + 1
    for k in range(CLASSES):
        n = batch.column(f"{count}{k}").to_numpy()
        at = np.flatnonzero(n)
        ends, a = np.cumsum(length[at]), 0
        while a < len(at):
            to = min(a + lot, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LOT_BYTES))))
            part = at[a:to]
            yield part, words[part].tolist(), np.full(len(part), k), n[part].astype(np.float64)
            a = to


def bit_tables(words: DataFrame, code, shards: int, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Packed bit counts of all training words, by context: 2 bytes a slot, 2**sizes of them (see ``mixing.sizes_for``)."""
    shared = words.sparkSession.sparkContext.broadcast(code)

    def count(batches):
        tables = [np.zeros(2 << s, np.float32) for s in sizes]
        for _, b in _blocks(batches):
            for _, w, k, c in _by_class(b, "c"):
                mixing.count_bits(mixing.Bits(w, k, shared.value, sizes), c, tables)
        for context, t in enumerate(tables):
            rows = t.reshape(-1, 2 * CHUNK)
            used = np.flatnonzero(rows.any(axis=1))
            for a in range(0, len(used), 64):
                part = used[a : a + 64]
                cols = [pa.array(np.full(len(part), context, np.int32)), pa.array(part.astype(np.int32)), pa.array([rows[i].tobytes() for i in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["context", "chunk", "counts"])

    def add(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for context, chunk, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n = np.frombuffer(n, np.float32).astype(np.float64)  # whole numbers: their sum has no order
                total[context, chunk] = total[context, chunk] + n if (context, chunk) in total else n
        for (context, chunk), n in total.items():
            packed = mixing.pack_counts(n).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([context], pa.int32()), pa.array([chunk], pa.int32()), pa.array([packed], pa.binary())], names=["context", "chunk", "counts"])

    schema = "context int, chunk int, counts binary"
    parts = _arrow(words.coalesce(shards), count, schema).repartition("context", "chunk")
    out = [np.zeros(1 << s, "<u2") for s in sizes]
    for r in _arrow(parts, add, schema).toLocalIterator():
        out[r["context"]][r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<u2")
    return out


def learn_mixer(words: DataFrame, start, shards: int) -> mixing.Mixer:
    """Weights learned online in each shard, in the order of its words, and averaged by its tokens; the refining map's counts add up."""
    cells = 1 << 20

    def run(batches):
        mixer = now = None
        tokens = 0.0

        def learned():
            seen = (mixer.map_counts - start.value.map_counts).reshape(-1)
            at = np.flatnonzero(seen)
            weights = np.rint(mixer.weights.reshape(-1) * FIXED).astype(np.int64)
            where = np.concatenate((at, cells + np.arange(len(weights))))
            value = np.concatenate((np.rint(seen[at]).astype(np.int64), weights * int(tokens)))
            count = np.concatenate((np.ones(len(at), np.int64), np.full(len(weights), int(tokens))))
            return pa.RecordBatch.from_arrays([pa.array(where), pa.array(value), pa.array(count)], names=["at", "value", "count"])

        for shard, b in _blocks(batches):
            if shard != now:
                if tokens:
                    yield learned()
                mixer, tokens, now = start.value.copy(), 0.0, shard
            for _, w, k, c in _by_class(b, "c", STEP):
                mixer.learn(mixing.Bits(w, k, mixer.code, mixer.sizes), c)
                tokens += c.sum()
        if tokens:
            yield learned()

    mixer = start.value.copy()
    got = _arrow(sharded(words, shards), run, "at long, value long, count long")
    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    for r in got.groupBy("at").agg(exact("value"), exact("count")).toLocalIterator():
        if r["at"] >= cells:
            mixer.weights.reshape(-1)[r["at"] - cells] = float(r["value"] / r["count"]) / FIXED
        else:
            mixer.map_counts.reshape(-1)[r["at"]] += float(r["value"])
    return mixer


_placed: list = []  # the last table of heavy words in this worker, and its places by class


def _places(heavy: pa.Table) -> list[dict[bytes, int]]:
    """Row of each heavy word by class; made once in a worker, for all its tasks."""
    if not _placed or _placed[0] is not heavy:
        place: list[dict[bytes, int]] = [{} for _ in range(CLASSES)]
        for i, (w, k) in enumerate(zip(heavy["word"].to_pylist(), heavy["k"].to_pylist(), strict=True)):
            place[k][w] = i
        _placed[:] = [heavy, place]
    return _placed[1]


def score_words(words: DataFrame, mixer) -> DataFrame:
    """word, k, c (training tokens in all classes), n (all tokens in this class) and log10 probability lp."""
    names = ["word", "k", "c", "n", "lp"]

    def run(batches):
        for _, b in _blocks(batches):
            total = sum(b.column(f"c{k}").to_numpy() for k in range(CLASSES))
            for at, w, k, n in _by_class(b, "n"):
                lp = -LOG2 * mixer.value.bits_of(mixing.Bits(w, k, mixer.value.code, mixer.value.sizes), len(w))
                cols = [pa.array(w, pa.binary()), pa.array(k.astype(np.int32)), pa.array(total[at]), pa.array(n.astype(np.int64)), pa.array(lp)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return _arrow(words, run, "word binary, k int, c long, n long, lp double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    model, code = survey(docs)
    paths: list[str] = []
    words = materialize(count_words(docs, model), "words", paths)
    known = " + ".join(f"c{k}" for k in range(CLASSES))
    every = " + ".join(f"n{k}" for k in range(CLASSES))
    sums = words.selectExpr(f"{known} AS c", f"{every} AS n").agg(F.sum("c"), F.sum("n"), F.expr("count_if(c > 0)"), F.count(F.lit(1))).first()
    train_tokens, tokens, distinct, rows = [v or 0 for v in sums]
    shards = max(1, -(-rows // SHARD))
    sc = spark.sparkContext
    sizes = mixing.sizes_for(rows)
    start = sc.broadcast(mixing.Mixer.start(code, bit_tables(words, code, shards, sizes)))
    mixer = learn_mixer(words, start, max(1, -(-rows // LEARN_SHARD)))
    scored = materialize(score_words(words, sc.broadcast(mixer)), "scored-words")
    discard(spark, paths)

    floor = train_tokens + 0.5 * (distinct + 1)
    base = lambda c: np.log10((c + 0.5) / floor)
    heavy = scored.filter(F.col("n") * (1 << HEAVY) >= tokens).select("word", "k", "c", "lp").toArrow()  # at most 2**HEAVY rows
    shared = sc.broadcast((model, heavy))
    names = ["rid", "k", "word", "n", "doc_id", "n_tokens", "n_bytes", "n_known", "base", "score"]

    def run(batches):
        model, heavy = shared.value
        c, lp = heavy["c"].to_numpy(), heavy["lp"].to_numpy()
        values = np.stack([np.append(c > 0, 0), np.append(base(c), 0.0), np.append(lp, 0.0)])  # the last: not heavy
        place = _places(heavy)
        for lot in _lots(batches):
            w = Words(lot.column("text"))
            n, rid = lot.num_rows, lot.column("rid").to_numpy()
            inside, end = w.classes(model)
            distinct, code = w.coded()
            pair, index = np.unique(code * CLASSES + inside, return_inverse=True)
            which, k = pair // CLASSES, pair % CLASSES
            keys = distinct.take(pa.array(which))
            place_of = np.full(len(pair), -1)
            for c in range(CLASSES):
                mine = np.flatnonzero(k == c)
                place_of[mine] = np.fromiter(map(place[c].get, keys.take(pa.array(mine)).to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int64, len(mine))
            at = place_of[index]
            ends = np.array([p.get(b"", -1) for p in place])[end]
            doc, found = np.concatenate((w.doc, np.arange(n))), np.concatenate((at, ends))
            known, b_sum, s_sum = (np.bincount(doc, v[found], minlength=n) for v in values)
            count = np.bincount(w.doc, minlength=n) + 1
            rare, times = np.unique(w.doc[at < 0] * len(pair) + index[at < 0], return_counts=True)
            open_ = np.flatnonzero(ends < 0)
            # one row that stands for the document, under a key that no word has, and its rare words and ends
            of = np.concatenate((rare // max(len(pair), 1), open_))
            rare = rare % max(len(pair), 1)
            m = len(of)
            zero = np.zeros(m, np.int64)
            names_of = pa.concat_arrays([pa.array(rid).cast(pa.string()).cast(pa.large_binary()), keys.take(pa.array(rare)), pa.array([b""] * len(open_), pa.large_binary())])
            cols = [
                pa.array(np.concatenate((rid, rid[of]))),
                pa.array(np.concatenate((np.full(n, -1), k[rare], end[open_])).astype(np.int32)),
                names_of.cast(pa.binary()),
                pa.array(np.concatenate((np.zeros(n, np.int64), times, np.ones(len(open_), np.int64)))),
                pa.concat_arrays([lot.column("doc_id"), pa.nulls(m, pa.int64())]),
                pa.array(np.concatenate((count, zero))),
                pa.array(np.concatenate((w.bytes, zero))),
                pa.array(np.concatenate((known.astype(np.int64), zero))),
                pa.array(np.concatenate((b_sum, np.zeros(m)))),
                pa.array(np.concatenate((s_sum, np.zeros(m)))),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    parts = _arrow(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text"),
        run,
        "rid long, k int, word binary, n long, doc_id long, n_tokens long, n_bytes long, n_known long, base double, score double",
    )
    # hashed, not sorted: a partition holds distinct words only, a small part of the rows that meet them
    light = scored.select("word", "k", "c", "lp").hint("shuffle_hash")
    joined = parts.join(light, ["k", "word"], "left")
    out = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.expr("n_known + IF(c > 0, n, 0)")).alias("n_known"),
        F.sum(F.expr(f"base + IF(c IS NULL, 0, n * log10((c + 0.5) / {floor!r}D))")).alias("base_score"),
        F.sum(F.expr("score + IF(lp IS NULL, 0, n * lp)")).alias("score"),
    )
    return out.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "n_bytes",
        (-F.col("score") / LOG2 / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over all documents."""
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))
