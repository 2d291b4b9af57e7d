"""Folds in the state store: late rows, restarts, what the state holds, life times and timers, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from vigilake.streaming import keyed

SECOND = 1_000_000
COLUMNS = "chat_id long, user_id long, event_id long, ts_us long"


def feed(spark, rows, schema, place):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)


def stream(spark, schema, place):
    return spark.readStream.schema(schema).parquet(place)


def state_rows(spark, replay, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{replay.place}/checkpoint")


def test_late_rows_count_where_they_belong(spark, tmp_path):
    """Three batches; a tenth of the rows come a batch late, within the wait; one comes behind the watermark and is left out."""
    random.seed(5)
    rows = [(e % 2, e % 5, e, t * SECOND) for e, t in enumerate(sorted(random.randrange(3000) for _ in range(300)))]
    late = {r[2] for r in rows if random.random() < 0.1 and r[2] < 200}
    place, source = f"file://{tmp_path}/work", f"file://{tmp_path}/in"
    parts = [[r for r in rows if (r[2] // 100 == k and r[2] not in late) or (r[2] // 100 == k - 1 and r[2] in late)] for k in range(3)]
    feed(spark, random.sample(parts[0], len(parts[0])), COLUMNS, source)
    replay = keyed.Replay(stream(spark, COLUMNS, source), keyed.message_counts(), place, wait="1100 seconds")
    replay.run()
    early = replay.results().count()
    assert early < len(parts[0])  # the rest waits
    feed(spark, random.sample(parts[1], len(parts[1])), COLUMNS, source)
    # a restart: all anew from the checkpoint
    replay = keyed.Replay(stream(spark, COLUMNS, source), keyed.message_counts(), place, wait="1100 seconds")
    replay.run()
    feed(spark, [*parts[2], (0, 0, 9_999, 1)], COLUMNS, source)
    replay.run()
    dropped = sum(p.get("numRowsDroppedByWatermark", 0) for u in replay.query.recentProgress for p in (s.asDict() if hasattr(s, "asDict") else {"numRowsDroppedByWatermark": s.numRowsDroppedByWatermark} for s in u.stateOperators))
    replay.close()
    got = {r.event_id: (r.chat_id, r.user_id, r.msg_no) for r in replay.results().collect()}
    want, n = {}, {}
    for chat, user, e, _ in rows:
        n[chat, user] = n.get((chat, user), 0) + 1
        want[e] = (chat, user, n[chat, user])
    assert got == want and dropped == 1
    kept = state_rows(spark, replay, "kept").select("key.*", "value.*").collect()
    assert {(r.chat_id, r.user_id): r.n for r in kept} == n


def test_a_batch_touches_its_own_keys_only(spark, tmp_path):
    place, source = f"file://{tmp_path}/work", f"file://{tmp_path}/in"
    feed(spark, [(c, 0, c, 10 * SECOND) for c in range(200)] + [(0, 1, 500, 11 * SECOND)], COLUMNS, source)
    replay = keyed.Replay(stream(spark, COLUMNS, source), keyed.message_counts(), place)
    replay.run()
    feed(spark, [(3, 0, 501, 20 * SECOND), (4, 0, 502, 21 * SECOND)], COLUMNS, source)
    replay.run()
    updated = [s.numRowsUpdated for u in replay.query.recentProgress for s in u.stateOperators]
    assert sum(updated) < 30  # two keys with their lists and timers and the one that waited, of 201 keys
    replay.close()
    assert replay.results().count() == 203


def limited(rows, limit, window):
    kept, out = {}, {}
    for user, e, t in sorted(rows, key=lambda r: (r[2], r[1])):
        hits = [h for h in kept.get(user, []) if t - h < window]
        out[e] = (len(hits) < limit, None if len(hits) < limit else hits[0] + window - t)
        kept[user] = hits + [t] if len(hits) < limit else hits
    return out


def test_rate_limit_with_retry_after_and_no_state_left(spark, tmp_path):
    random.seed(6)
    rows = [(random.randrange(4), e, random.randrange(2000) * SECOND) for e in range(250)]
    source = f"file://{tmp_path}/in"
    feed(spark, rows, "user_id long, event_id long, ts_us long", source)
    replay = keyed.Replay(stream(spark, "user_id long, event_id long, ts_us long", source), keyed.rate_limit(2, 60), f"file://{tmp_path}/work")
    replay.run()
    replay.close()
    assert {r.event_id: (r.allowed, r.retry_after_us) for r in replay.results().collect()} == limited(rows, 2, 60 * SECOND)
    assert state_rows(spark, replay, "kept").count() == 0


def test_clean_scans_and_changes(spark, tmp_path):
    random.seed(7)
    rows = [(random.randrange(3), random.randrange(2), e, random.randrange(5000) * SECOND, random.random() < 0.7) for e in range(300)]
    changes = [(random.randrange(3), random.randrange(5000) * SECOND) for _ in range(12)]
    source, schema = f"file://{tmp_path}/in", "chat_id long, user_id long, event_id long, ts_us long, clean boolean"
    feed(spark, rows, schema, source)
    table = spark.createDataFrame(changes, "chat_id long, changed_us long")
    out = keyed.replayed(spark, stream(spark, schema, source), keyed.clean_interval(900, ["chat_id", "user_id"]), f"file://{tmp_path}/work", arranged=lambda d: keyed.last_change(d, table, "chat_id"))
    want, since = [], {}
    for chat, user, e, t, clean in sorted(rows, key=lambda r: (r[3], r[2])):
        s = since.get((chat, user))
        if s is not None and (t >= s + 900 * SECOND or any(c == chat and s < x <= t for c, x in changes)):
            s = None
        if s is None:
            want.append((e, t, clean))
            s = t if clean else None
        since[chat, user] = s
    assert sorted((r.event_id, r.ts_us, r.clean) for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("life", [300, 21_600])
def test_cached_answers(spark, tmp_path, life):
    random.seed(8)
    rows = [(random.randrange(3), e, random.randrange(5000) * SECOND, 0.5, random.choice([None, 0.2, 0.4, 0.7]), random.random() < 0.3) for e in range(200)]
    source, schema = f"file://{tmp_path}/in", "user_id long, event_id long, ts_us long, bar double, fast double, verified boolean"
    feed(spark, rows, schema, source)
    arranged = lambda d: d.withColumn("changed_us", F.lit(None).cast("long"))
    out = keyed.replayed(spark, stream(spark, schema, source), keyed.cached_answers(life, ["user_id"]), f"file://{tmp_path}/work", arranged=arranged)
    want, kept = [], {}
    for user, e, t, bar, fast, verified in sorted(rows, key=lambda r: (r[2], r[1])):
        k = kept.get(user)
        if k and t - k[0] < life * SECOND and (k[2] or k[1] < bar):
            want.append((e, "cache", k[1]))
            continue
        if fast is not None:
            kept[user] = (t, fast, verified)
        want.append((e, "scored", fast))
    assert sorted((r.event_id, r.source, r.score) for r in out.collect()) == sorted(want)


def test_delayed_delete_comes_by_timer(spark, tmp_path):
    source, schema, place = f"file://{tmp_path}/in", "message_id long, event_id long, ts_us long, ttl long", f"file://{tmp_path}/work"
    feed(spark, [(1, 1, 100 * SECOND, 0), (2, 2, 100 * SECOND, 50), (3, 3, 100 * SECOND, 10**9), (4, 4, 170 * SECOND, 60)], schema, source)
    replay = keyed.Replay(stream(spark, schema, source), keyed.delayed_delete(), place)
    replay.run()
    due = lambda: sorted((r.message_id, r.delete_at_us // SECOND) for r in replay.results().collect())
    assert due() == [(1, 105), (2, 150)]  # those before the watermark
    replay.close()
    assert due() == [(1, 105), (2, 150), (3, 86_500), (4, 230)]


# ---- lots of keys (F1, F3, F4, F6 to F9) ---------------------------------------------------------


def test_lots_late_rows_and_restarts(spark, tmp_path):
    """As with keys of their own: late rows, a restart, a row behind the watermark; the state is a block for each lot, not a row for each key."""
    random.seed(5)
    rows = [(e % 2, e % 50, e, t * SECOND) for e, t in enumerate(sorted(random.randrange(3000) for _ in range(600)))]
    late = {r[2] for r in rows if random.random() < 0.1 and r[2] < 400}
    place, source = f"file://{tmp_path}/work", f"file://{tmp_path}/in"
    parts = [[r for r in rows if (r[2] // 200 == k and r[2] not in late) or (r[2] // 200 == k - 1 and r[2] in late)] for k in range(3)]
    for k, part in enumerate(parts):
        feed(spark, random.sample(part, len(part)) + [(0, 0, 9_999, 1)] * (k == 2), COLUMNS, source)
        replay = keyed.Replay(stream(spark, COLUMNS, source), keyed.message_counts(), place, wait="1100 seconds", lots=3)
        replay.run()
        if k == 0:
            assert replay.results().count() < len(part)  # the rest waits
    updated = [s.numRowsUpdated for u in replay.query.recentProgress for s in u.stateOperators]
    replay.close()
    got = {r.event_id: (r.chat_id, r.user_id, r.msg_no) for r in replay.results().collect()}
    want, n = {}, {}
    for chat, user, e, _ in rows:
        n[chat, user] = n.get((chat, user), 0) + 1
        want[e] = (chat, user, n[chat, user])
    assert got == want and replay.results().count() == len(want)
    assert sum(updated) < 40  # there are 50 keys, in three lots


def test_lots_in_many_blocks_end_their_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BLOCK", 7)
    random.seed(6)
    rows = [(random.randrange(40), e, random.randrange(2000) * SECOND) for e in range(500)]
    schema, source = "user_id long, event_id long, ts_us long", f"file://{tmp_path}/in"
    feed(spark, rows, schema, source)
    replay = keyed.Replay(stream(spark, schema, source), keyed.rate_limit(2, 60), f"file://{tmp_path}/work", lots=4)
    replay.run()
    replay.close()
    assert {r.event_id: (r.allowed, r.retry_after_us) for r in replay.results().collect()} == limited(rows, 2, 60 * SECOND)
    for name in ("kept", "waiting"):
        assert state_rows(spark, replay, name).filter("key.lot IS NOT NULL").count() <= 1  # the closing row's lot may hold that row


def test_lots_delete_by_timer(spark, tmp_path):
    source, schema, place = f"file://{tmp_path}/in", "message_id long, event_id long, ts_us long, ttl long", f"file://{tmp_path}/work"
    feed(spark, [(1, 1, 100 * SECOND, 0), (2, 2, 100 * SECOND, 50), (3, 3, 100 * SECOND, 10**9), (4, 4, 170 * SECOND, 60), (5, 5, 170 * SECOND + 1, 60)], schema, source)
    replay = keyed.Replay(stream(spark, schema, source), keyed.delayed_delete(), place, lots=2)
    replay.run()
    due = lambda: sorted((r.message_id, r.delete_at_us) for r in replay.results().collect())
    assert due() == [(1, 105 * SECOND), (2, 150 * SECOND)]
    feed(spark, [(6, 6, 300 * SECOND, 60)], schema, source)
    replay.run()
    assert due()[2:] == [(4, 230 * SECOND), (5, 230 * SECOND + 1)]
    replay.close()
    assert due() == [(1, 105 * SECOND), (2, 150 * SECOND), (3, 86_500 * SECOND), (4, 230 * SECOND), (5, 230 * SECOND + 1), (6, 360 * SECOND)]


def test_lots_with_text_keys_and_nulls(spark, tmp_path):
    random.seed(9)
    rows = [(random.randrange(3), f"text {random.randrange(4)}", e, random.randrange(5000) * SECOND, 0.5, random.choice([None, 0.2, 0.7]), False, random.choice([None, 2000 * SECOND])) for e in range(200)]
    rows = [(*r[:7], r[7] if r[7] is None or r[7] <= r[3] else None) for r in rows]
    source, schema = f"file://{tmp_path}/in", "chat_id long, text_key string, event_id long, ts_us long, bar double, fast double, verified boolean, changed_us long"
    feed(spark, rows, schema, source)
    out = []
    for lots in (None, 3):
        fold = keyed.cached_answers(900, ["chat_id", "text_key"], {"text_key": "string"})
        got = keyed.replayed(spark, stream(spark, schema, source), fold, f"file://{tmp_path}/work{lots}", lots=lots)
        out.append(sorted(map(str, got.collect())))
    assert out[0] == out[1] and len(out[0]) == 200


def test_last_change_compares_few(spark):
    random.seed(10)
    crowd = [(2, 10**6 + k) for k in range(50)] + [(2, 1), (2, 10**9)]
    changes = [(0, random.randrange(10**7)) for _ in range(900)] + [(1, 500), (1, 500)] + crowd + [(None, 5), (3, None)]
    events = [(random.randrange(5), e, random.randrange(-10, 10**7 + 10)) for e in range(400)]
    events += [(c, 1000 + k, t + d) for k, (c, t) in enumerate(changes) if c is not None and t is not None for d in (-1, 0, 1)]
    table = spark.createDataFrame(changes, "chat_id long, changed_us long")
    got = keyed.last_change(spark.createDataFrame(events, "chat_id long, event_id long, ts_us long"), table, "chat_id").collect()
    times = {c: sorted({t for k, t in changes if k == c and t is not None}) for c in range(5)}
    assert len(got) == len(events)
    for r in got:
        assert r.changed_us == max((t for t in times[r.chat_id] if t <= r.ts_us), default=None)
    spans, full = keyed.slots(table, "chat_id")
    assert full.filter("chat_id = 0").selectExpr("max(size(_times))").first()[0] < 40  # of 900
    assert full.count() <= len(changes)
