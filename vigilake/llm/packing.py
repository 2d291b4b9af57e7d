"""Best-fit packing of documents into sequences, by bulk-synchronous rounds.

A round is a Spark job over two sorted tables, open documents by length and gaps of open
sequences by size:

1. Both are range-sorted by size, largest first. Going down, each gap is laid on a pile and each
   document takes the topmost, which is the smallest gap that holds it and isn't taken: its
   successor. Heights of the pile follow from running sums inside the ranges; the driver carries
   one sum over each range to the next.
2. Documents and gaps of the same heights meet in one slice (one shuffle), where a sweep matches
   them: longest first, lowest rank first, each to its successor. A gap that has been used goes on
   with what it has left. Documents for which the pile was empty are dealt to the slices in order.
3. What is placed is written, gaps are updated, and what is left goes into the next round. Where
   the longest document fits no gap, new sequences are opened first: for all documents over half
   the capacity, else for as many as the volume left over needs. Where it needs none, few are opened,
   and more with each opening.

Rows of both tables are runs, (size, first rank or sequence, number), because documents of one
length are alike: a round's tables have some thousand rows whatever the number of documents, and
10 to 50 rounds place them all. Ranks are given out by Spark within (length, bucket) and shifted
by the counts of the buckets before, so that no length meets in one task; each row then finds its
run by binary search in the broadcast runs (bounded by lengths x rounds).

Nulls: a null text is empty (one piece with the end token), a null doc_id is carried. Repeated
rows are packed one by one. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vigilake.llm.bpe import encoder_of, over_batches
from vigilake.llm.common import discard, materialize, small_batches, table

CAPACITY = 1024
END_ID = 2
SLICES, SLICE, RANGES = 8, 1000, 16  # most slices, fewest sequences or documents of one, ranges of sizes
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Kinds of rows of a round: a gap, open documents, placed documents.
GAP, OPEN, PLACED = 0, 1, 2
#: Characters that are encoded at once.
LOT = 2_000_000
STATE_NAMES = ["kind", "size", "first", "n", "deep", "sequence", "offset"]
STATE = ", ".join(f"{k} long" for k in STATE_NAMES)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of at most ``capacity`` ids; of a longer document only the first piece is shorter."""
    with open(path, encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())
    schema = df.sparkSession.createDataFrame([], PIECES).schema

    def run(batches):
        encoder = encoder_of(definition.value)
        for keys, texts in over_batches(batches, lot=LOT):
            ids, n = encoder.encode_flat(texts)
            ends = np.cumsum(n)
            raw = memoryview(np.insert(ids, ends, end_id).astype("<u4")).cast("B")
            n, begin = n + 1, ends - n + np.arange(len(n))
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            short = n - (count - 1) * capacity  # length of the first piece
            start = np.where(piece > 0, short[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, short[doc])
            at = begin[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [pa.array(keys, pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class _Gaps:
    """Gaps by size, as runs of sequence numbers."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes = 0  # bit g is set where some sequence has a gap of g

    def add(self, gap: int, first: int, n: int) -> None:
        if gap:
            self.runs.setdefault(gap, []).append((first, n))
            self.sizes |= 1 << gap

    def successor(self, length: int) -> int | None:
        above = self.sizes >> length
        return length + (above & -above).bit_length() - 1 if above else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        first, n = self.runs[gap].pop()
        if n > most:
            self.runs[gap].append((first + most, n - most))
        elif not self.runs[gap]:
            self.sizes &= ~(1 << gap)
        return first, min(n, most)


def sweep(rows: list[tuple[int, int, int, int]], capacity: int) -> list[tuple[int, ...]]:
    """Matches the documents and gaps (kind, size, first, n) of a slice; rows of STATE.

    A placed row puts ``deep`` documents into each of ``n`` sequences from ``sequence`` on, from
    ``offset`` on; its documents are ranks ``first`` to ``first + n * deep``.
    """
    gaps, out = _Gaps(), []
    for kind, size, first, n in sorted(rows):
        if kind == GAP:
            gaps.add(size, first, n)
    for length, first, n in sorted(((s, f, n) for kind, s, f, n in rows if kind == OPEN), key=lambda r: (-r[0], r[1])):
        while n and (gap := gaps.successor(length)) is not None:
            sequence, k = gaps.take(gap, n)
            deep = min(gap // length, n // k)
            out.append((PLACED, length, first, k, deep, sequence, capacity - gap))
            first, n = first + k * deep, n - k * deep
            gaps.add(gap - deep * length, sequence, k)
        if n:
            out.append((OPEN, length, first, n, 0, 0, 0))
    out += [(GAP, size, first, n, 0, 0, 0) for size, runs in gaps.runs.items() for first, n in runs]
    return out


Rows = np.ndarray  # kind, size, first, n


def _rows(group: pa.Table) -> Rows:
    """Rows of a range, largest size first, gaps before the documents of their size."""
    rows = np.stack([group.column(k).to_numpy() for k in ("kind", "size", "first", "n")], axis=1).astype(np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0], -rows[:, 1]))]


def _piles(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of gaps less documents, and the lowest so far (0 at most), with those before the first row."""
    total = np.concatenate(([0], np.cumsum(np.where(rows[:, 0] == GAP, rows[:, 3], -rows[:, 3]))))
    return total, np.minimum.accumulate(total)


def _sums(rows: Rows) -> dict[str, int]:
    total, low = _piles(rows)
    size, volume = {k: rows[rows[:, 0] == k, 1] for k in (GAP, OPEN)}, rows[:, 1] * rows[:, 3]
    return {
        "net": total[-1], "low": low[-1], "top": total.max(), "rise": (total - low).max(), "longest": size[OPEN].max(initial=0),
        "largest": size[GAP].max(initial=0), "volume": volume[rows[:, 0] == OPEN].sum() - volume[rows[:, 0] == GAP].sum(),
    }


def _cut(rows: Rows, low: np.ndarray, high: np.ndarray, width: int) -> list[tuple[int, ...]]:
    """The rows' parts (slice, kind, size, first, n) where they hold places ``low`` to ``high`` of slices of one width."""
    return [
        (at, kind, size, first + max(a, at * width) - a, min(b, (at + 1) * width) - max(a, at * width))
        for (kind, size, first, _), a, b in zip(rows.tolist(), low.tolist(), high.tolist(), strict=True)
        for at in range(a // width, -(-b // width) if b > a else 0)
    ]


def _sliced(rows: Rows, height: int, missed: int, widths: tuple[int, int]) -> list[tuple[int, ...]]:
    """Parts of the rows by slice: by heights of the pile, or for want of a gap by order."""
    total, low = _piles(rows)
    pile, alone = np.maximum(height + total, total - low), missed + np.maximum(0, -(height + low))
    met = rows.copy()
    met[:, 2] += np.abs(np.diff(pile))  # ranks behind those that meet a gap
    return _cut(rows, np.minimum(pile[1:], pile[:-1]), np.maximum(pile[1:], pile[:-1]), widths[0]) + _cut(met, alone[:-1], alone[1:], widths[1])


def _wants(rows: Rows, bar: int, capacity: int) -> np.ndarray:
    """Sequences that the documents longer than ``bar`` would fill, by row."""
    return np.where((rows[:, 0] == OPEN) & (rows[:, 1] > bar), -(-rows[:, 3] // (capacity // rows[:, 1])), 0)


def _opened(rows: Rows, bar: int, ahead: int, room: int, sequences: int, capacity: int) -> list[tuple[int, ...]]:
    """Rows of STATE after new sequences, at most ``room`` in all, of which ``ahead`` are for longer documents."""
    out = []
    for (kind, size, first, n), wants in zip(rows.tolist(), _wants(rows, bar, capacity).tolist(), strict=True):
        got, at = max(0, min(wants, room - ahead)), sequences + ahead
        ahead += wants
        most = capacity // size
        full = min(got, n // most)
        for k, deep, begin in ((full, most, at), (got - full, n % most, at + full)):
            if k:
                out.append((PLACED, size, first, k, deep, begin, 0))
                out.append((GAP, capacity - deep * size, begin, k, 0, 0, 0))
                first, n = first + k * deep, n - k * deep
        if n:
            out.append((kind, size, first, n, 0, 0, 0))
    return [r for r in out if r[1]]


class Round:
    """One state of both tables, the sums over its ranges, and what follows from it; ``scarce``: openings without need so far."""

    def __init__(self, state: DataFrame, capacity: int, scarce: int, sequences: int):
        self.capacity, self.scarce, self.sequences = capacity, scarce, sequences
        self.ranged = state.filter(F.col("kind") != PLACED).withColumn("range", F.floor(F.col("size") / -(-(capacity + 1) // RANGES)).cast("int"))
        got = self._each_range(lambda _, rows: [tuple(int(x) for x in _sums(rows).values())], list(_sums(np.zeros((0, 4), np.int64)))).collect()
        self.longest, self.largest = (max((r[k] for r in got), default=0) for k in ("longest", "largest"))
        self.volume = sum(r["volume"] for r in got)
        self.height, self.carry = 0, {}
        height = missed = 0
        for r in sorted(got, key=lambda r: -r["range"]):
            self.carry[r["range"]] = height, missed
            self.height = max(self.height, height + r["top"], r["rise"])
            empty = max(0, -(height + r["low"]))
            height, missed = height + r["net"] + empty, missed + empty
        self.missed = missed

    def _each_range(self, work, names: list[str]) -> DataFrame:
        """Rows of longs that ``work(range, rows)`` makes of each range, with the range."""
        names = ["range", *names]

        def run(group: pa.Table) -> pa.Table:
            key = group.column("range")[0].as_py()
            out = [(key, *r) for r in work(key, _rows(group))]
            return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(names), names=names)

        return self.ranged.groupBy("range").applyInArrow(run, ", ".join(f"{k} long" for k in names))

    def swept(self) -> DataFrame:
        """The next state: what the slices placed, and what is left."""
        carry, capacity, names = self.carry, self.capacity, STATE_NAMES
        widths = tuple(max(SLICE, -(-n // SLICES)) for n in (self.height, self.missed))
        parts = self._each_range(lambda k, rows: _sliced(rows, *carry[k], widths), ["slice", "kind", "size", "first", "n"])

        def run(group: pa.Table) -> pa.Table:
            columns = [group.column(k).to_pylist() for k in ("kind", "size", "first", "n")]
            out = sweep(list(zip(*columns, strict=True)), capacity)
            return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        return parts.groupBy("slice").applyInArrow(run, STATE)

    def with_new_sequences(self) -> tuple[DataFrame, int]:
        """The state with sequences opened for the longest documents, which fit no gap, and how many were opened."""
        capacity, sequences = self.capacity, self.sequences
        alone = self.longest > capacity // 2
        bar = max(self.largest, capacity // 2 if alone else self.longest // 2)
        need = self.volume // capacity
        room = 1 << 62 if alone else need if need > 0 else 1 << min(40, max(0, self.scarce - 3))
        wanted = self._each_range(lambda _, rows: [(int(_wants(rows, bar, capacity).sum()),)], ["n"]).collect()  # as many rows as ranges
        ahead, total = {}, 0
        for r in sorted(wanted, key=lambda r: -r["range"]):
            ahead[r["range"]], total = total, total + r["n"]
        return self._each_range(lambda k, rows: _opened(rows, bar, ahead[k], room, sequences, capacity), STATE_NAMES).drop("range"), min(total, room)


def place_runs(counts: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """Placed runs (length, first rank, n, deep, sequence, offset) for (size, n) documents by length."""
    rest = [F.lit(0).cast("long").alias(k) for k in ("deep", "sequence", "offset")]
    state = counts.select(F.lit(OPEN).cast("long").alias("kind"), F.col("size").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), *rest)
    scarce = sequences = 0
    paths: list[str] = []
    state = materialize(state, "lengths", paths)
    while (now := Round(state, capacity, scarce, sequences)).longest:
        if now.longest > now.largest:
            new, made = now.with_new_sequences()
            scarce, sequences = scarce + (now.longest <= capacity // 2 and now.volume < capacity), sequences + made
        else:
            new = now.swept()
        state = materialize(new, "round", paths)
    spark = counts.sparkSession
    placed = spark.read.schema(state.schema).parquet(*paths).filter(F.col("kind") == PLACED).drop("kind")
    found = [tuple(r) for r in placed.collect()]  # bounded by lengths x rounds
    discard(spark, paths)
    return np.array(sorted(found), np.int64).reshape(-1, 6)


def ranked(rows: DataFrame, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """Rows with bucket and rank in (length, bucket); how many rows of a length come before each bucket."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "bucket").count().collect()  # at most capacity x buckets rows
    longest = max((r["length"] for r in counts), default=0)
    n = np.zeros((longest + 1, buckets), np.int64)
    for r in counts:
        n[r["length"], r["bucket"]] = r["count"]
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    return rows.withColumn("rank", F.row_number().over(inside) - 1), n


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of (doc_id, text)."""
    spark = df.sparkSession
    made = materialize(pieces(df, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    buckets = min(1024, max(32, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows, n = ranked(made, buckets)
    runs = place_runs(made.groupBy(F.col("length").alias("size")).agg(F.count(F.lit(1)).alias("n")), capacity)
    before = np.cumsum(n, axis=1) - n
    shared = spark.sparkContext.broadcast((before, runs))
    schema = spark.createDataFrame([], PIECES + ", sequence_id long, offset long").schema

    def run(batches):
        before, runs = shared.value
        key = runs[:, 0] << 44 | runs[:, 1]
        for b in batches:
            length, bucket, rank = (b.column(b.schema.names.index(k)).to_numpy() for k in ("length", "bucket", "rank"))
            rank = before[length, bucket] + rank
            at = runs[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            inside, deep = rank - at[:, 1], at[:, 3]
            new = [pa.array(at[:, 4] + inside // deep), pa.array(at[:, 5] + inside % deep * length)]
            kept = [b.column(b.schema.names.index(k)) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=schema.names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over all documents."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
