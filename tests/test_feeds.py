"""Feeds: updates that can't be read, deliveries that are repeated, results that don't match their requests."""

import json

import pytest
from pyspark.sql import functions as F

from vigilake.operators import position
from vigilake.plans import queries as plans
from vigilake.sources import updates
from vigilake.streaming import delivery


def test_updates_of_every_kind_and_none(spark):
    chat, user = {"id": -5, "type": "supergroup"}, {"id": 7, "is_bot": False}
    lines = [
        json.dumps({"update_id": 1, "message": {"message_id": 1, "chat": chat, "from": user, "text": "/unban@OUR_bot 12\nmore", "date": 0, "extra": [1]}}),
        json.dumps({"update_id": 2, "message": {"message_id": 1, "chat": {"id": 7, "type": "private"}, "from": user, "caption": "/Start"}}),
        json.dumps({"update_id": 3, "message": {"message_id": 1, "chat": chat, "text": "/start@other hi"}}),
        json.dumps({"update_id": 4, "callback_query": {"id": "1", "from": user, "data": "p:not"}}),
        json.dumps({"update_id": 5, "my_chat_member": {"chat": chat, "from": user, "old_chat_member": {"status": "left"}, "new_chat_member": {"status": "member"}}}),
        json.dumps({"update_id": 6, "chat_member": {"chat": chat, "from": user}}),
        json.dumps({"update_id": 7, "message_reaction": {"chat": chat, "user": user, "message_id": 9, "new_reaction": ["a"]}}),
        json.dumps({"update_id": 8, "poll": {}}), json.dumps({"message": {"chat": chat}}), json.dumps([1]), '{"update_id": 9', "", None, "x" * 100_000, json.dumps({"update_id": "nine", "message": {}}),
    ]
    rows = updates.parsed(spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "value string, update_id int"), "our_bot").collect()
    assert len(rows) == len(lines)
    got = [(r.update_id, r.route, r.command, r.args) for r in rows if r.malformed is None]
    assert got == [(1, "command", "unban", "12\nmore"), (2, "private", None, None), (3, "group", None, None), (4, "callback", None, None), (5, "own_member", None, None), (6, "member", None, None), (7, "reaction", None, None)]
    assert [r.malformed for r in rows if r.malformed] == ["unknown kind", "no number"] + ["no JSON object"] * 6
    assert [r.raw for r in rows] == lines and rows[4].new_status == "member" and rows[6].new_reaction == ["a"]


def test_a_repeated_batch_sends_nothing_twice(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def send(targets, bodies):
        calls.add(len(targets))
        return ["user_blocked" if t == 3 else None for t in targets]

    runs = spark.createDataFrame([(1, 5, "users", "hi")], "broadcast_id long, author_id long, target string, body string")
    to = spark.createDataFrame([(0, k, k + 1, k // 25) for k in range(60)] + [(1, 99, 61, 2)], "part int, target long, seq long, second long")
    runs = delivery.open_runs(runs, to)
    box = delivery.outbox(runs, to)
    assert runs.first().total == 60 and box.count() == 60
    place = f"file://{tmp_path}"
    work = delivery.batch_work(place, send)
    assert not delivery.closed_runs(runs, spark.createDataFrame([], delivery.OUTCOME)).first().finished
    for _ in range(3):
        work(box.filter("seq <= 40"), 0)
    assert calls.value == 40
    work(box.filter("seq > 40"), 1)
    work(box.filter("seq > 40"), 1)
    assert calls.value == 60
    last = delivery.closed_runs(runs, delivery.outcomes(spark, place)).first()
    assert (last.sent, last.failed, last.finished) == (59, 1, True)
    assert [(r.target, r.failure) for r in delivery.outcomes(spark, place).filter("failure IS NOT NULL").collect()] == [(3, "is_blocked")]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    calls, place = spark.sparkContext.accumulator(0), f"file://{tmp_path}"

    def send(targets, bodies):
        calls.add(len(targets))
        return [None] * len(targets)

    schema = "broadcast_id long, seq long, target long, is_user boolean, second long, body string"
    rows = spark.range(30).selectExpr("1L AS broadcast_id", "id + 1 AS seq", "id AS target", "true AS is_user", "id div 25 AS second", "'b' AS body")
    for n in (1, 2):
        rows.filter(F.col("seq") % 2 == n - 1).write.mode("append").parquet(f"{place}/box")
        delivery.deliver(spark.readStream.schema(schema).parquet(f"{place}/box"), place, send)
        assert calls.value == 15 * n
    assert delivery.outcomes(spark, place).count() == 30


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_and_zip(spark, tmp_path, parts):
    n = iter(range(100))

    def write(df):
        path = f"file://{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    ids = spark.range(1000).selectExpr("(id * 7919) % 1000 AS id", "id % 3 AS request").repartition(parts)
    placed = position.positions(ids, ["id"], write)
    assert placed.columns == ["id", "request", "position"] and all(r.position == r.id for r in placed.collect())
    results = spark.range(0, 1000, 1, parts).selectExpr("id * 2 AS score")
    both = position.zipped(ids, results, ["id"], [], write).collect()
    assert len(both) == 1000 and all(r.result.score == 2 * r.request.id and r.mismatch is None for r in both)
    short = position.zipped(ids, results.filter("score < 1900"), ["id"], [], write).filter("mismatch IS NOT NULL").collect()
    assert sorted(r.request.id for r in short) == list(range(950, 1000)) and {r.mismatch for r in short} == {"no result"}
    long = position.zipped(ids.filter("id < 990"), results, ["id"], [], write).filter("mismatch = 'no request'")
    assert sorted(r.result.score for r in long.collect()) == list(range(1980, 2000, 2))
    ties = position.positions(spark.range(50).selectExpr("id % 2 AS k", "id"), ["k"], write).collect()
    assert sorted(r.position for r in ties) == list(range(50)) and all((r.position < 25) == (r.k == 0) for r in ties)
    assert position.positions(ids.limit(0), ["id"], write).count() == 0


def test_some_reactions_are_judged(spark, data):
    rows = plans.QUERIES["reaction_verdicts"](spark, data.replace("0.001", "0.01")).collect()
    assert rows and all(r.message_id is None for r in rows) and {r.matched for r in rows} == {True, False}
