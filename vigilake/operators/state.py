"""Keyed state in batch: message numbers, time-to-live and rate limits, folds of changes into snapshots.

Snapshots are plain Parquet, which has no MERGE: a fold unites the old rows with the changes and
keeps what the rules say, in one shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
PERMANENT = ["user_blocked", "user_deactivated"]


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def message_number(events: DataFrame, keys=("chat_id", "user_id"), order=("ts", "event_id")) -> DataFrame:
    """Number of each message in its (chat, user), this one included."""
    return events.withColumn("msg_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def prior_messages(events: DataFrame, is_message: Column, keys=("chat_id", "user_id"), order=("ts", "event_id")) -> DataFrame:
    """Messages before each event."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("prior", F.coalesce(F.sum(is_message.cast("long")).over(w), F.lit(0)).cast("long"))


def in_grace(grace: Column, number: Column) -> Column:
    """Whether a message is still scanned; a grace of 0 scans all."""
    return ~((grace > 0) & (number > grace))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key, by partial aggregation (no sort of whole groups)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def fold_in_order(rows: DataFrame, keys: list[str], order: list[Column], schema: str, make: Callable) -> DataFrame:
    """Rows dealt by key, sorted within, and folded one by one; a task holds a batch of rows and one key's state.

    ``make()`` starts a key and returns (step, last): step(row without the keys) gives a row without
    the keys or None, last() one after the key's rows or None.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step, last = None, None, None

        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                key = row[: len(keys)]
                if key != now:
                    if now is not None and (got := last()) is not None:
                        out.append(now + got)
                    now, (step, last) = key, make()
                if (got := step(*row[len(keys) :])) is not None:
                    out.append(now + got)
            yield batch(out)
        if now is not None and (got := last()) is not None:
            yield batch([now + got])

    rest = [c for c in rows.columns if c not in keys]
    return dealt.select(*keys, *rest).mapInArrow(run, schema)


def _types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def _nothing() -> None:
    return None


def every_interval(events: DataFrame, keys: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """ST02: greedy fold; events that are scanned because the last scanned one is ``seconds`` old or more.

    A key's events pass in order of time; its state is the last scan. Equal stamps are one scan.
    Events without a time are left out.
    """

    def make():
        scanned = None

        def step(t):
            nonlocal scanned
            if scanned is not None and (t == scanned or t - scanned < seconds * 1_000_000):
                return None
            scanned = t
            return (t,)

        return step, _nothing

    rows = events.select(*keys, micros(ts).alias("scanned_us")).filter("scanned_us IS NOT NULL")
    return fold_in_order(rows, keys, [F.col("scanned_us")], f"{_types(rows, keys)}, scanned_us long", make)


def limiter(limit: int, seconds: int, hits: list[int]) -> Callable[[int], bool]:
    """Whether the attempt at a time is allowed; ``hits``, the allowed ones still young enough, are at most ``limit``."""
    limit, window = max(1, limit), seconds * 1_000_000

    def allowed(t: int) -> bool:
        hits[:] = [h for h in hits if t - h < window]
        if len(hits) >= limit:
            return False
        hits.append(t)
        return True

    return allowed


def rate_limit(events: DataFrame, key: str, limit: int, seconds: int, ts: str = "ts") -> DataFrame:
    """ST05: allowed attempts only count; a hit counts while it is younger than the window.

    Returns (key, ts_us, n, allowed): n-th attempt of a key, in order of time. Events without a time are left out.
    """

    def make():
        allowed, n = limiter(limit, seconds, []), 0

        def step(t):
            nonlocal n
            n += 1
            return t, n, allowed(t)

        return step, _nothing

    rows = events.select(key, micros(ts).alias("ts_us")).filter("ts_us IS NOT NULL")
    return fold_in_order(rows, [key], [F.col("ts_us")], f"{_types(rows, [key])}, ts_us long, n long, allowed boolean", make)


def fold_bans(bans: DataFrame, pardons: DataFrame) -> DataFrame:
    """DML04, DML05: the last ban of each (chat, user); a pardon holds if it came after that ban."""
    last = latest(bans, ["chat_id", "user_id"], F.col("banned_at"), F.col("id"))
    later = (
        pardons.join(last.select("chat_id", "user_id", "banned_at"), ["chat_id", "user_id"])
        .filter("unbanned_at > banned_at").groupBy("chat_id", "user_id").agg(F.max("unbanned_at").alias("unbanned_at"))
    )
    return last.join(later, ["chat_id", "user_id"], "left")


def other_group_bans(bans: DataFrame) -> DataFrame:
    """AG05, J07: active bans of a user in chats other than each of theirs; counts less the own, no theta join."""
    active = bans.filter("unbanned_at IS NULL").select("chat_id", "user_id").distinct()
    total = active.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    pairs = bans.select("chat_id", "user_id").distinct()
    own = active.withColumn("own", F.lit(1))
    return (
        pairs.join(own, ["chat_id", "user_id"], "left").join(total, "user_id", "left")
        .select("chat_id", "user_id", (F.coalesce("total", F.lit(0)) - F.coalesce("own", F.lit(0))).cast("long").alias("other_bans"))
    )


def fold_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """DML10: all columns of the newest row; its missing labels are taken over only from the same fingerprint and pipeline."""
    last = latest(new, ["user_id"], F.col("scanned_at"))
    both = last.alias("n").join(old.alias("o"), "user_id", "full_outer")
    same = (F.col("n.fingerprint") == F.col("o.fingerprint")) & (F.col("n.pipeline") == F.col("o.pipeline"))
    has = F.col("n.scanned_at").isNotNull()
    pick = lambda c: F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    labels = F.when(has, F.coalesce("n.labels", F.when(same, F.col("o.labels")))).otherwise(F.col("o.labels"))
    return both.select("user_id", *[pick(c) for c in ("fingerprint", "pipeline", "fast", "scanned_at")], labels.alias("labels"))


def prune_cache(cache: DataFrame, as_of: str, days: int, pipeline: str) -> DataFrame:
    """DML11: rows young enough (1 to 3650 days) and of this pipeline."""
    days = max(1, min(3650, days))
    return cache.filter((F.col("scanned_at") >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS")) & (F.col("pipeline") == pipeline))


def cached_evidence(labels: Column, fast: Column, group_score: Column, threshold: Column) -> Column:
    """ST07: struct <state, score>: verified with this group's categories, screened below its bar, or a miss."""
    return F.struct(
        F.when(labels.isNotNull(), "verified").when(fast >= threshold, "miss").otherwise("screened").alias("state"),
        F.when(labels.isNotNull(), group_score).when(fast < threshold, fast).alias("score"),
    )


def toggle(items: Column, item: Column) -> Column:
    """SE02: out if it is there, in if it isn't, case ignored."""
    there = F.exists(items, lambda x: F.lower(x) == F.lower(item))
    return F.when(there, F.filter(items, lambda x: F.lower(x) != F.lower(item))).otherwise(F.array_append(items, item))


def delivery_failure(error: Column) -> Column:
    """What a failed delivery says of its target."""
    return F.when(error.isin(*PERMANENT), "is_blocked").when(error.isin("bot_kicked", "chat_not_found"), "inactive").when(error.isNotNull(), "failed")


def overlay(old: DataFrame, changes: DataFrame, keys: list[str], column: str, seq: str = "seq") -> DataFrame:
    """DML12: an update of one column: the last change of a key, for rows that are there."""
    last = changes.groupBy(*keys).agg(F.max_by(column, seq).alias("_new"), F.lit(True).alias("_is"))
    joined = old.join(last, keys, "left")
    return joined.withColumn(column, F.when(F.col("_is"), F.col("_new")).otherwise(F.col(column))).select(*old.columns)


def fold_appeals(events: DataFrame) -> DataFrame:
    """DML08, DML09, CT06: appeals of each (chat, user) from (chat_id, user_id, seq, event), in order.

    ``open`` opens one unless one is open; ``approve`` and ``reject`` resolve the open one, if any. One row for each
    appeal: its number, when it was opened and resolved (by seq), status, and requests that met it open.
    An appeal is a run of openings with the resolutions after it, of which the first counts.
    """
    keys = ["chat_id", "user_id"]
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = events.select(*keys, F.col("seq").cast("long").alias("seq"), "event").filter(F.col("event").isin("open", "approve", "reject"))
    opens = F.col("event") == "open"
    rows = rows.withColumn("begins", opens & (F.coalesce(F.lag("event").over(w), F.lit("")) != "open"))
    rows = rows.withColumn("number", F.sum(F.col("begins").cast("long")).over(w)).filter("number > 0")
    ends = F.when(~opens, F.struct("seq", "event"))
    out = rows.groupBy(*keys, "number").agg(F.min(F.when(opens, F.col("seq"))).alias("opened"), F.min(ends).alias("end"), F.count_if(opens).alias("requests"))
    status = F.when(F.col("end").isNull(), "open").when(F.col("end.event") == "approve", "approved").otherwise("rejected")
    return out.select(*keys, "number", "opened", F.col("end.seq").alias("resolved"), status.alias("status"), "requests")


def fold_users(events: DataFrame) -> DataFrame:
    """DML02, DML03, DML12, DML18: users from (user_id, seq, event, username, lang), in order.

    ``touch`` and ``start`` add a user or renew the name; ``start`` also makes the user reachable and sets an unlocked
    language; ``lang`` adds a user or sets and locks the language; ``blocked`` marks one that is there.
    """
    seq = F.col("seq").cast("long")
    of = lambda *names: F.col("event").isin(*names)
    row = F.struct(seq.alias("seq"), "username", "lang")
    latest_of = lambda *names: F.max(F.when(of(*names), row))
    u = events.groupBy("user_id").agg(
        F.min(F.when(of("touch", "start", "lang"), row)).alias("first"), latest_of("touch", "start").alias("named"), latest_of("lang").alias("told"),
        latest_of("start").alias("started"), F.max(F.when(of("blocked"), seq)).alias("blocked"),
    ).filter("first IS NOT NULL")
    last_word = lambda c: F.when(F.col("told").isNotNull(), F.col(f"told.{c}")).when(F.col("started").isNotNull(), F.col(f"started.{c}")).otherwise(F.col(f"first.{c}"))
    return u.select(
        "user_id", F.when(F.col("named").isNotNull(), F.col("named.username")).otherwise(F.col("first.username")).alias("username"), last_word("lang").alias("lang"),
        F.col("told").isNotNull().alias("lang_locked"), F.col("started").isNotNull().alias("started_bot"),
        F.coalesce((F.col("blocked") > F.col("first.seq")) & (F.col("blocked") > F.coalesce("started.seq", "first.seq")), F.lit(False)).alias("is_blocked"),
        F.col("first.seq").alias("first_seq"), F.coalesce("named.seq", "first.seq").alias("last_seq"),
    )


def toggled(presses: DataFrame, keys: list[str]) -> DataFrame:
    """DML07: the first press sets it, each later one turns it."""
    return presses.groupBy(*keys).agg((F.count(F.lit(1)) % 2 == 1).alias("dm_notify"))


def every_clean_interval(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """ST02 with P16: scans from (keys, ts_us, clean, voids): a clean scan suppresses the next ones for ``seconds``; a row with ``voids`` drops that."""

    def make():
        until = None

        def step(t, clean, voids):
            nonlocal until
            if voids:
                until = None
                return None
            if until is not None and t < until:
                return None
            if clean:
                until = t + seconds * 1_000_000
            return t, clean

        return step, _nothing

    rows = events.select(*keys, "ts_us", "clean", "voids").filter("ts_us IS NOT NULL")
    return fold_in_order(rows, keys, [F.col("ts_us"), F.col("voids").desc(), F.col("clean")], f"{_types(rows, keys)}, ts_us long, clean boolean", make)


def cached_answers(requests: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """ST03, ST04, ST06: requests (keys, ts_us, bar, fast, verified) against a cache with a life time: struct of source and score.

    An entry answers while younger than ``seconds``, if it is verified or its score is under the request's bar; else the
    request is scored, and stored unless its score is null.
    """

    def make():
        kept = None

        def step(t, bar, fast, verified):
            nonlocal kept
            if kept and t - kept[0] < seconds * 1_000_000 and (kept[2] or kept[1] < bar):
                return t, "cache", kept[1]
            if fast is not None:
                kept = (t, fast, verified)
            return t, "scored", fast

        return step, _nothing

    rows = requests.select(*keys, "ts_us", "bar", "fast", "verified").filter("ts_us IS NOT NULL")
    order = [F.col(c) for c in ("ts_us", "bar", "fast", "verified")]
    return fold_in_order(rows, keys, order, f"{_types(rows, keys)}, ts_us long, source string, score double", make)


def take_once(commands: DataFrame, seconds: int = 600) -> DataFrame:
    """ST08, DML17: (admin_id, ts_us, command, body): ``compose`` keeps a draft, ``confirm`` within ``seconds`` takes it, any other drops it.

    So a draft is taken by the admin's next command or not at all. Commands are in order of time, command and body.
    """
    w = Window.partitionBy("admin_id").orderBy("ts_us", "command", "body")
    before = F.lag(F.struct("ts_us", "command", "body")).over(w)
    rows = commands.select("admin_id", "ts_us", "command", "body").withColumn("before", before)
    taken = (F.col("command") == "confirm") & (F.col("before.command") == "compose") & (F.col("ts_us") - F.col("before.ts_us") < seconds * 1_000_000)
    return rows.filter(taken).select("admin_id", "ts_us", F.col("before.body").alias("body"))


def with_cache(events: DataFrame, cache: DataFrame, fingerprint: Column, pipeline: str) -> DataFrame:
    """J05, ST07: each event with the cached evidence of its user, if of the same photos and pipeline; no row is null evidence."""
    mine = cache.filter(F.col("pipeline") == pipeline).select("user_id", F.col("fingerprint").alias("_seen"), "fast", "labels")
    rows = events.withColumn("_now", fingerprint)
    joined = rows.join(mine, (rows.user_id == mine.user_id) & (F.col("_now") == F.col("_seen")), "left").drop(mine.user_id)
    return joined.drop("_now", "_seen")
