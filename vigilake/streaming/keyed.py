"""Keyed folds over streams, with their state in Spark's state store (RocksDB) and event-time timers.

A row waits in the list state of its key until the watermark has passed it; then the key's rows are folded in
order of time and id. So a row that comes late, but not later than ``wait``, counts where it belongs, and the
results are those of the batch form over all rows that weren't later than that. Rows behind the watermark are
left out by Spark and counted in the query's progress (numRowsDroppedByWatermark).

A micro-batch touches the keys that it brings rows or timers for, and no others. A fold's state goes when its life time
is over. Restarts go on from the checkpoint. Each touched key costs some ten calls to the state server; a stream whose batches bring rows of
many keys, or many rows of a key, deals its keys to ``lots`` instead (``InLots``): a lot's rows and states lie in the state store as blocks of columns,
so that calls grow with the lots, and a batch reads and writes the states of the lots that it touches. The streams here end with ``close``: a row far in the future that
lets the watermark pass everything that still waits, which a stream that goes on never needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilake.operators.state import limiter

#: Key and time of the row that closes a stream: no chat or user has that id, and pandas knows no much later time.
END, END_US = -(1 << 63), 9_200_000_000_000_000
#: Lots that the registered streams deal their keys to, and rows of a block. A lot is in one task at a time; their number can't change on a checkpoint.
LOTS, BLOCK = 256, 65_536
#: Changes that an event is compared with, if they are spread evenly.
IN_SLOT = 8
_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@dataclass
class KeyedFold:
    """How rows (event_id, ts_us, then ``columns``) of a key become results.

    ``step(state, event_id, ts_us, *columns)`` gives (state, result or None); ``state`` is None or a tuple of type ``state_type``;
    ``ends(state)`` is the time in microseconds from which the state can't matter any more, or None;
    ``at_end(state)`` is a result to be given then, or None.
    """

    keys: list[str]
    columns: dict[str, str]
    results: dict[str, str]
    state_type: str
    step: Callable
    ends: Callable = field(default=lambda state: None)
    at_end: Callable = field(default=lambda state: None)
    key_types: dict[str, str] = field(default_factory=dict)  # of keys that aren't long

    @property
    def schema(self) -> str:
        return ", ".join([f"{k} {self.key_types.get(k, 'long')}" for k in self.keys] + [f"{c} {t}" for c, t in self.results.items()])

    @property
    def row_type(self) -> str:
        return ", ".join(["event_id long", "ts_us long", *[f"{c} {t}" for c, t in self.columns.items()]])


class InOrder(StatefulProcessor):
    """Rows of a key wait for the watermark and are folded in order of (ts_us, event_id)."""

    def __init__(self, fold: KeyedFold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fold.row_type)
        self.kept = handle.getValueState("kept", self.fold.state_type)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = ["event_id", "ts_us", *self.fold.columns]
        # nulls make floats of long columns, which the state would hold as nulls
        whole = [self.fold.columns.get(c, "long") == "long" for c in names]
        new = [
            tuple(None if pd.isna(x) else int(x) if w else x for x, w in zip(r, whole, strict=True))
            for frame in rows
            for r in zip(*[frame[c].tolist() for c in names], strict=True)
        ]
        yield from self._advance(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, [], timerValues)

    def _advance(self, key, new: list[tuple], times) -> Iterator[pd.DataFrame]:
        passed = times.getCurrentWatermarkInMs() * 1000
        waited = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted([*waited, *new], key=lambda r: (r[1], r[0]))
        due = [r for r in rows if r[1] <= passed]
        rest = rows[len(due) :]
        before = tuple(got) if (got := self.kept.get()) is not None else None
        state, out = before, []
        for r in due:
            if r[0] == END:
                continue
            if (ends := self._ends(state)) is not None and ends <= r[1]:
                state = self._end(state, out)
            state, result = self.fold.step(state, *r)
            if result is not None:
                out.append(result)
        if (ends := self._ends(state)) is not None and ends <= passed:
            state, ends = self._end(state, out), None
        if state is None and before is not None:
            self.kept.clear()
        elif state is not None and state != before:
            self.kept.update(state)
        if rest:
            if new or due:
                self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][1] // 1000))
        elif waited:
            self.waiting.clear()
        if ends is not None:
            self.handle.registerTimer(-(-ends // 1000))
        if out:
            keys = {k: [x] * len(out) for k, x in zip(self.fold.keys, key, strict=True)}
            yield pd.DataFrame({**keys, **{c: [r[i] for r in out] for i, c in enumerate(self.fold.results)}})

    def _ends(self, state) -> int | None:
        return None if state is None else self.fold.ends(state)

    def _end(self, state, out: list) -> None:
        if (last := self.fold.at_end(state)) is not None:
            out.append(last)

    def close(self) -> None:
        pass


class InLots(StatefulProcessor):
    """The same folds for lots of keys: rows of a lot wait as Arrow blocks, and are folded in order of (ts_us, event_id) when the watermark has passed them."""

    def __init__(self, fold: KeyedFold):
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
        keys = ", ".join(f"{k} {fold.key_types.get(k, 'long')}" for k in fold.keys)
        self.fold = fold
        self.row, self.state = arrow(f"{keys}, {fold.row_type}"), arrow(f"{keys}, {fold.state_type}")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "n long", "block binary")
        self.kept = handle.getMapState("kept", "n long", "block binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, new, size = None, [], 0
        at = self._next(self.waiting)
        for frame in rows:
            columns = [pa.array(frame[f.name], f.type, from_pandas=True) for f in self.row]
            new.append(pa.RecordBatch.from_arrays(columns, schema=self.row))
            size += len(frame)
            first = min(first or END_US, int(frame["ts_us"].min()))
            if size >= BLOCK:
                at, new, size = self._write(self.waiting, pa.Table.from_batches(new), at), [], 0
        if new:
            self._write(self.waiting, pa.Table.from_batches(new), at)
        if first is not None and first <= timerValues.getCurrentWatermarkInMs() * 1000:
            yield from self._advance(timerValues)
        elif first is not None:
            self._wake(first, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(timerValues)

    def _advance(self, times) -> Iterator[pd.DataFrame]:
        passed = times.getCurrentWatermarkInMs() * 1000
        rows = self._read(self.waiting, self.row)
        ts, ids = (rows.column(c).to_numpy() for c in ("ts_us", "event_id"))
        due, rest = np.flatnonzero(ts <= passed), np.flatnonzero(ts > passed)
        due = due[np.lexsort((ids[due], ts[due]))]
        due = due[ids[due] != END]
        if len(rest) < len(rows):
            self.waiting.clear()
            self._write(self.waiting, rows.take(rest), 0)
        width = len(self.fold.keys)
        kept = self._read(self.kept, self.state)
        states = {key: state for part in self._blocks(kept) for key, state in self._tuples(part, width)}
        del kept
        step, ends, changed, out = self.fold.step, self._ends, len(due) > 0, []
        for at in range(0, len(due), BLOCK):
            for key, r in self._tuples(rows.take(due[at : at + BLOCK]), width):
                state = states.pop(key, None)
                if (until := ends(state)) is not None and until <= r[1]:
                    state = self._end(key, state, out)
                state, result = step(state, *r)
                if state is not None:
                    states[key] = state
                if result is not None:
                    out.append((*key, *result))
            if len(out) >= BLOCK:
                yield self._frame(out)
                out = []
        left = []
        for key, state in list(states.items()):
            if (until := ends(state)) is None:
                continue
            if until <= passed:
                self._end(key, states.pop(key), out)
                changed = True
            else:
                left.append(until)
        if changed:
            self.kept.clear()
            held = [(*key, *state) for key, state in states.items()]
            for n, at in enumerate(range(0, len(held), BLOCK)):
                part = [pa.array(c, f.type) for c, f in zip(zip(*held[at : at + BLOCK], strict=True), self.state, strict=True)]
                self._write(self.kept, pa.Table.from_arrays(part, schema=self.state), n)
        if len(rest):
            left.append(int(ts[rest].min()))
        self._wake(min(left, default=None), times)
        if out:
            yield self._frame(out)

    def _ends(self, state) -> int | None:
        return None if state is None else self.fold.ends(state)

    def _end(self, key: tuple, state, out: list) -> None:
        if (last := self.fold.at_end(state)) is not None:
            out.append((*key, *last))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip([*self.fold.keys, *self.fold.results], map(list, zip(*out, strict=True)), strict=True)))

    def _wake(self, us: int | None, times) -> None:
        """A timer at ``us``, unless the lot has one before that still has to come."""
        if us is None:
            return
        passed, wanted = times.getCurrentWatermarkInMs(), -(-us // 1000)
        if all(t > wanted or t <= passed for t in self.handle.listTimers()):
            self.handle.registerTimer(wanted)

    @staticmethod
    def _blocks(table: pa.Table) -> Iterator[pa.Table]:
        for at in range(0, len(table), BLOCK):
            yield table.slice(at, BLOCK)

    @staticmethod
    def _tuples(table: pa.Table, width: int) -> Iterator[tuple[tuple, tuple]]:
        """(key, other columns) of each row."""
        columns = [c.to_pylist() for c in table.columns]
        others = zip(*columns[width:], strict=True)
        return zip(zip(*columns[:width], strict=True), others, strict=True)

    @staticmethod
    def _next(state) -> int:
        return max((n for (n,) in state.keys()), default=-1) + 1 if state.exists() else 0

    def _write(self, state, table: pa.Table, at: int) -> int:
        """Blocks from number ``at`` on; the next number."""
        for part in self._blocks(table.combine_chunks()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(part)
            state.updateValue((at,), (sink.getvalue().to_pybytes(),))
            at += 1
        return at

    @staticmethod
    def _read(state, schema: pa.Schema) -> pa.Table:
        blocks = [n for (n,) in state.keys()] if state.exists() else []
        tables = [pa.ipc.open_stream(bytes(state.getValue((n,))[0])).read_all() for n in sorted(blocks)]
        return pa.concat_tables(tables) if tables else schema.empty_table()

    def close(self) -> None:
        pass


# ---- the folds ---------------------------------------------------------------------------------


def message_counts() -> KeyedFold:
    """ST01: running number of each (chat, user)'s messages; never ends."""

    def step(state, event_id, ts_us):
        n = (state[0] if state else 0) + 1
        return (n,), (event_id, n)

    return KeyedFold(["chat_id", "user_id"], {}, {"event_id": "long", "msg_no": "long"}, "n long", step)


def rate_limit(limit: int, seconds: int) -> KeyedFold:
    """ST05: allowed attempts younger than the window are the state, ``limit`` at most; it ends two windows after the last of them.

    A rejected attempt says in how many microseconds the oldest kept one leaves the window.
    """
    window = seconds * 1_000_000

    def step(state, event_id, ts_us):
        hits = list(state[0]) if state else []
        ok = limiter(limit, seconds, hits)(ts_us)
        return (hits,), (event_id, ok, None if ok else hits[0] + window - ts_us)

    results = {"event_id": "long", "allowed": "boolean", "retry_after_us": "long"}
    return KeyedFold(["user_id"], {}, results, "hits array<bigint>", step, ends=lambda s: max(s[0]) + 2 * window)


def clean_interval(seconds: int, keys: list[str]) -> KeyedFold:
    """ST02 with P16: a clean scan suppresses the next ones for ``seconds``, unless the chat's settings changed after it (``changed_us``)."""
    life = seconds * 1_000_000

    def step(state, event_id, ts_us, clean, changed_us):
        if state and changed_us is not None and changed_us > state[0]:
            state = None
        if state:
            return state, None
        return ((ts_us,) if clean else None), (event_id, ts_us, bool(clean))

    columns = {"clean": "boolean", "changed_us": "long"}
    return KeyedFold(keys, columns, {"event_id": "long", "ts_us": "long", "clean": "boolean"}, "since long", step, ends=lambda s: s[0] + life)


def cached_answers(seconds: int, keys: list[str], key_types: dict[str, str] | None = None) -> KeyedFold:
    """ST03, ST04, ST06: an entry answers for ``seconds``, if it is verified or its score is under the request's bar; else the request is scored
    and stored, unless its score is null. ``changed_us``, the last change that voids entries, may be null.
    """
    life = seconds * 1_000_000

    def step(state, event_id, ts_us, bar, fast, verified, changed_us):
        if state and changed_us is not None and changed_us > state[0]:
            state = None
        if state and (state[2] or state[1] < bar):
            return state, (event_id, ts_us, "cache", state[1])
        if fast is not None:
            state = (ts_us, float(fast), bool(verified))
        return state, (event_id, ts_us, "scored", fast)

    columns = {"bar": "double", "fast": "double", "verified": "boolean", "changed_us": "long"}
    results = {"event_id": "long", "ts_us": "long", "source": "string", "score": "double"}
    return KeyedFold(keys, columns, results, "since long, fast double, verified boolean", step, ends=lambda s: s[0] + life, key_types=key_types or {})


def delayed_delete(low: int = 5, high: int = 86_400) -> KeyedFold:
    """SNK08, ST12: a message (its id as the key) is to be deleted ``ttl`` seconds after it was sent, clamped; the row comes by a timer."""

    def step(state, event_id, ts_us, ttl):
        due = ts_us + max(low, min(high, ttl)) * 1_000_000
        return (due if state is None else min(due, state[0]),), None

    return KeyedFold(["message_id"], {"ttl": "long"}, {"delete_at_us": "long"}, "due long", step, ends=lambda s: s[0], at_end=lambda s: s)


# ---- running them ------------------------------------------------------------------------------


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """SRC01: a folder or file of Parquet as a stream. A stream takes folders or patterns but no single file, so the path is written as a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def folded(rows: DataFrame, fold: KeyedFold, wait: str = "0 seconds", lots: int | None = None) -> DataFrame:
    """Results of a stream of (keys, event_id, ts_us, columns); rows without a time or key are left out. ``lots``: how many lots the keys are dealt to."""
    given = rows.select(*fold.keys, "event_id", "ts_us", *fold.columns).dropna(subset=[*fold.keys, "event_id", "ts_us"])
    timed = given.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", wait)
    if lots:
        dealt = timed.withColumn("lot", F.pmod(F.xxhash64(*fold.keys), F.lit(lots)).cast("int"))
        return dealt.groupBy("lot").transformWithStateInPandas(InLots(fold), fold.schema, "Append", "EventTime")
    return timed.groupBy(*fold.keys).transformWithStateInPandas(InOrder(fold), fold.schema, "Append", "EventTime")


def slots(changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Changes (key, changed_us) by equal slots of each key's time, about ``IN_SLOT`` to a slot: (key, _first, _last, _width), and
    (key, _slot, _times, _before) with the sorted changes of each slot and the last one before it. Slots are at most as many as changes.
    """
    times = changes.select(key, "changed_us").dropna().distinct()
    spans = times.groupBy(key).agg(F.min("changed_us").alias("_first"), F.max("changed_us").alias("_last"), F.count(F.lit(1)).alias("_n"))
    spans = spans.select(key, "_first", "_last", F.expr(f"(_last - _first) div greatest(1, _n div {IN_SLOT}) + 1").alias("_width"))
    full = times.join(spans, key).groupBy(key, F.expr("(changed_us - _first) div _width").alias("_slot")).agg(F.sort_array(F.collect_list("changed_us")).alias("_times"))
    by = Window.partitionBy(key).orderBy("_slot")
    full = full.withColumns({"_before": F.lag(F.array_max("_times")).over(by), "_next": F.lead("_slot").over(by)})
    gaps = full.filter("_next > _slot + 1").select(key, F.explode(F.expr("sequence(_slot + 1, _next - 1)")).alias("_slot"), F.expr("filter(_times, t -> false)").alias("_times"), F.array_max("_times").alias("_before"))
    return spans, full.select(*gaps.columns).unionAll(gaps)


def last_change(events: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Events with ``changed_us``, the last of the changes (key, changed_us) of their key that aren't after them, as joins of a stream with a table.

    An event meets the changes of its slot only, not all of its key. Changes that crowd in a small part of a key's time share a slot.
    """
    spans, full = slots(changes, key)
    placed = events.join(spans, key, "left").withColumn("_slot", F.expr("IF(ts_us >= _first AND ts_us < _last, (ts_us - _first) div _width, NULL)"))
    joined = placed.join(full, [key, "_slot"], "left")
    found = F.expr("IF(ts_us >= _last, _last, coalesce(array_max(filter(_times, t -> t <= ts_us)), _before))")
    return joined.select(*[c for c in events.columns if c != "changed_us"], found.alias("changed_us"))


class Replay:
    """A fold over a stream that can be run again and again over what has come, and closed at the end."""

    def __init__(self, stream: DataFrame, fold: KeyedFold, place: str, wait: str = "0 seconds", arranged: Callable[[DataFrame], DataFrame] = lambda rows: rows, lots: int | None = None):
        self.spark, self.fold, self.place = stream.sparkSession, fold, place
        self.wait, self.lots = wait, lots
        end = self._last().limit(0)
        end.write.mode("ignore").parquet(f"{place}/end")
        closing = self.spark.readStream.schema(end.schema).parquet(f"{place}/end")
        self.rows = arranged(stream.unionByName(closing, allowMissingColumns=True))

    def _last(self) -> DataFrame:
        row = {k: F.lit(END).cast(self.fold.key_types.get(k, "long")) for k in [*self.fold.keys, "event_id"]} | {"ts_us": F.lit(END_US)}
        return self.spark.range(1).select(*[c.alias(k) for k, c in row.items()])

    def run(self) -> None:
        """All that is there and new, to the results' folder."""
        before = {k: self.spark.conf.get(k, None) for k in _ROCKSDB}
        for k, v in _ROCKSDB.items():
            self.spark.conf.set(k, v)
        try:
            out = folded(self.rows, self.fold, self.wait, self.lots).writeStream.format("parquet").outputMode("append").option("path", f"{self.place}/out")
            self.query = out.option("checkpointLocation", f"{self.place}/checkpoint").trigger(availableNow=True).start()
            self.query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def close(self) -> None:
        """Let everything that waits pass."""
        self._last().write.mode("append").parquet(f"{self.place}/end")
        self.run()

    def results(self) -> DataFrame:
        return self.spark.read.schema(self.fold.schema).parquet(f"{self.place}/out")


def replayed(spark: SparkSession, stream: DataFrame, fold: KeyedFold, place: str, lots: int | None = LOTS, **more) -> DataFrame:
    """All results of a stream over what is there now; keys are dealt to lots, as all rows come in one batch."""
    replay = Replay(stream, fold, place, lots=lots, **more)
    replay.run()
    replay.close()
    return replay.results()
