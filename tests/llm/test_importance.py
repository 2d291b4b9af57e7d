"""Importance resampling: automaton against a pattern and zlib, all columns against plain Python, ranks over partitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from vigilake.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def expect(docs, target, percent=25, least=20):
    each = [(d, *slow_features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in slow_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for d, n, f in each:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    good = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(good):
        r.append(k + 1 if k < percent * len(good) // 100 else None)
    return [(*r[:4], r[5] if len(r) > 5 else None) for r in out]


def key(rows):
    return sorted([tuple(r) for r in rows], key=str)


def got(df, target):
    return key(importance.importance(df, target).select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_automaton_by_brute_force():
    random.seed(1)
    texts = ["".join(random.choice("aZ9é漢 -_\n\x7f") for _ in range(random.randrange(40))) for _ in range(400)]
    texts += ["", None, "x" * 5000 + " " + "Y" * 4000, "end", "É", " lead", "trail "]
    for at in (0, 3, len(texts) - 1):
        part = pa.array(texts).slice(at)
        text, bucket, words = importance.features(part)
        for k, t in enumerate(texts[at:]):
            n, want = slow_features(t)
            assert words[k] == n and Counter(bucket[text == k].tolist()) == Counter(want)
    text, bucket, words = importance.features(pa.array([], pa.string()))
    assert len(text) == len(bucket) == len(words) == 0


def test_edge_rows(spark):
    random.seed(2)
    words = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(random.choices(words, k=random.choice((19, 20, 21, 60))))) for k in range(200)]
    docs += [(1000, None), (1001, ""), (None, "a b " * 15), (1002, "x" * 50_000 + " y" * 30), *[(5, "same words here " * 9)] * 60, *[(k, "Copy of it " * 9) for k in range(2000, 2100)]]
    target = [" ".join(random.choices(words[:40], k=50)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(t, d, 0) for d, t in docs], "text string, doc_id long, weight int")
    to = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(df, to) == key(expect(docs, target))
    ranks = [r[4] for r in got(df, to) if r[4]]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))
    assert got(df.limit(0), to) == [] and got(df, to.limit(0)) == key(expect(docs, []))
    few = [d for d in docs if d[0] in (1000, 1001)]
    assert got(df.filter("doc_id in (1000, 1001)"), to) == key(expect(few, target))
    drawn = importance.draw(df, to)
    assert drawn.columns == df.columns and drawn.count() == len(ranks)


def test_lots_do_not_matter(spark, monkeypatch):
    texts = pa.array(["a b c", None, "", "D e" * 40, "f"] * 20)
    batch = pa.record_batch({"text": texts})
    whole = np.bincount(importance.features(texts)[1], minlength=10_000)
    monkeypatch.setattr(importance, "LOT", 50)
    lots = list(importance._lots(batch))
    assert len(lots) > 10 and sum(lot.num_rows for lot in lots) == 100
    assert (sum(np.bincount(importance.features(lot.column("text"))[1], minlength=10_000) for lot in lots) == whole).all()


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert key(importance.query(spark, data).collect()) == key(expect(docs, target))
