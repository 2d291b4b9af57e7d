"""Keyed folds: one key of many events."""

import random
from collections import deque

from pyspark.sql import functions as F

from vigilake.operators import state

T = "cast(cast(timestamp_micros(t) AS TIMESTAMP) AS TIMESTAMP_NTZ)"


def slow_limit(times, limit, window):
    hits, out = deque(), []
    for t in sorted(times):
        while hits and t - hits[0] >= window:
            hits.popleft()
        out.append((t, len(hits) < limit))
        if out[-1][1]:
            hits.append(t)
    return out


def test_hot_key_is_folded_row_by_row(spark):
    n = 300_000  # one key's time stamps; copied at each step they wouldn't end
    df = spark.range(n).selectExpr("if(id % 1000 = 0, null, 7L) AS k", "id * 700000 % 300000000000L AS t").withColumn("ts", F.expr(T))
    times = {k: [i * 700000 % 300000000000 for i in range(n) if (i % 1000 == 0) == (k is None)] for k in (7, None)}
    got = {(r.k, r.n): (r.ts_us, r.allowed) for r in state.rate_limit(df, "k", 3, 60).collect()}
    want = {(k, i + 1): x for k, ts in times.items() for i, x in enumerate(slow_limit(ts, 3, 60_000_000))}
    assert got == want
    plan = state.rate_limit(df, "k", 3, 60)._jdf.queryExecution().toString() + state.every_interval(df, ["k"], 60)._jdf.queryExecution().toString()
    assert "collect_" not in plan
    scans = sorted(r.scanned_us for r in state.every_interval(df, ["k"], 60).collect() if r.k == 7)
    want, last = [], None
    for t in sorted(set(times[7])):
        if last is None or t - last >= 60_000_000:
            want.append(last := t)
    assert scans == want


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (2, 5), (2, None)], "k long, t long").withColumn("ts", F.expr(T))
    assert sorted((r.k, r.ts_us, r.n, r.allowed) for r in state.rate_limit(df, "k", 1, 60).collect()) == [(2, 5, 1, True), (2, 5, 2, False)]
    assert [(r.k, r.scanned_us) for r in state.every_interval(df, ["k"], 0).collect()] == [(2, 5)]
    assert state.rate_limit(df.limit(0), "k", 1, 60).count() == 0


def slow_users(rows):
    users = {}
    for user, seq, event, name, lang in sorted(rows, key=lambda r: r[1]):
        u = users.get(user)
        if event == "blocked":
            if u:
                u["blocked"] = True
            continue
        if u is None:
            u = users[user] = {"name": name, "lang": lang, "locked": False, "started": False, "blocked": False, "first": seq, "last": seq}
        if event == "lang":
            u["lang"], u["locked"] = lang, True
            continue
        u["name"], u["last"] = name, seq
        if event == "start":
            u["started"], u["blocked"] = True, False
            if not u["locked"]:
                u["lang"] = lang
    return {k: tuple(u.values()) for k, u in users.items()}


def slow_appeals(rows):
    out, state = [], {}
    for chat, user, seq, event in sorted(rows, key=lambda r: r[2]):
        number, opened, requests = state.get((chat, user), (0, None, 0))
        if event == "open":
            if opened is None:
                number, opened, requests = number + 1, seq, 0
            requests += 1
        elif event in ("approve", "reject") and opened is not None:
            out.append((chat, user, number, opened, seq, "approved" if event == "approve" else "rejected", requests))
            opened = None
        state[chat, user] = number, opened, requests
    return sorted(out + [(*k, n, o, None, "open", r) for k, (n, o, r) in state.items() if o is not None], key=str)


def test_folds_of_users_appeals_and_drafts_row_by_row(spark):
    random.seed(11)
    rows = [(random.randrange(12), seq, random.choice(["touch", "start", "lang", "blocked", "other"] if seq % 3 else ["blocked"]), random.choice([None, f"n{seq}"]), random.choice([None, "fa", "ru"])) for seq in range(160)]
    rows = [r for r in rows if r[2] != "other"]
    got = state.fold_users(spark.createDataFrame(rows, "user_id long, seq int, event string, username string, lang string")).collect()
    assert {r.user_id: tuple(r)[1:] for r in got} == slow_users(rows)

    rows = [(random.randrange(2), random.randrange(4), seq, random.choice(["open", "open", "approve", "reject", "noise"])) for seq in range(200)]
    got = state.fold_appeals(spark.createDataFrame(rows, "chat_id long, user_id long, seq int, event string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_appeals(rows)

    rows = [(random.randrange(3), t * 1_000_000, random.choice(["compose", "confirm", "cancel"]), f"b{t}") for t in sorted(random.sample(range(4000), 150))]
    want, draft = [], {}
    for admin, t, command, body in rows:
        kept = draft.pop(admin, None)
        if command == "compose":
            draft[admin] = (t, body)
        elif command == "confirm" and kept and t - kept[0] < 60_000_000:
            want.append((admin, t, kept[1]))
    got = state.take_once(spark.createDataFrame(rows, "admin_id long, ts_us long, command string, body string"), 60).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and want
