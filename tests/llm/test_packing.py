"""Best-fit packing: pieces against the library, gapless sequences, and how few they are."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from vigilake.llm import packing

PATH = P.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def test_runs_are_whole_and_few(spark):
    random.seed(7)
    for capacity, most, same in ((8, 40, 0), (64, 400, 300), (1024, 400, 0), (1024, 30, 300)):
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, most))] + [random.randint(1, capacity)] * same
        counts = {}
        for n in lengths:
            counts[n] = counts.get(n, 0) + 1
        runs = packing.place_runs(spark.createDataFrame(list(counts.items()), "size long, n long"), capacity)
        fill, ranks = {}, {}
        for length, rank, n, deep, first, offset in runs.tolist():
            ranks.setdefault(length, []).extend(range(rank, rank + n * deep))
            for s in range(first, first + n):
                fill.setdefault(s, []).extend((offset + k * length, length) for k in range(deep))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for rows in fill.values():
            rows.sort()
            assert [o for o, _ in rows] == [sum(x for _, x in rows[:k]) for k in range(len(rows))]
            assert sum(x for _, x in rows) <= capacity
        assert len(fill) <= best_fit_decreasing(lengths, capacity) + 1
    assert not len(packing.place_runs(spark.createDataFrame([], "size long, n long")))


def test_sweep_takes_the_smallest_gap_that_holds():
    rows = [(packing.GAP, 9, 0, 1), (packing.GAP, 5, 7, 2), (packing.OPEN, 5, 0, 1), (packing.OPEN, 4, 0, 2), (packing.OPEN, 10, 3, 1)]
    out = packing.sweep(rows, 20)
    placed = sorted(r[1:] for r in out if r[0] == packing.PLACED)
    assert placed == [(4, 0, 1, 1, 8, 15), (4, 1, 1, 1, 0, 11), (5, 0, 1, 1, 7, 15)]
    assert sorted(r[:4] for r in out if r[0] != packing.PLACED) == [(packing.GAP, 1, 8, 1), (packing.GAP, 5, 0, 1), (packing.OPEN, 10, 3, 1)]


def check(rows, texts, capacity=1024):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, got in by_doc.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        got.sort(key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert sum(r.length for r in got) == len(ids)
        assert all(r.length == capacity for r in got[1:])
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for got in by_sequence.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_query(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = packing.query(spark, data).collect()
    n = check(rows, texts)
    assert n <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_edge_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a  b <|endoftext|> c", None: "x"}
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()], "doc_id long, text string, length int, row int")
    check(packing.pack(df, PATH).collect(), texts)
    twice = packing.pack(df.filter("doc_id = 3").unionAll(df.filter("doc_id = 3")), PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.pack(df.limit(0), PATH).count() == 0
