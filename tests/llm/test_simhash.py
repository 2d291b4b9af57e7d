"""SimHash against all pairs on small tables."""

import random

import numpy as np
import xxhash

from vigilake.llm import simhash


def slow_print(text):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, most=3):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


TEXTS = ["a b c d", "A  b\tC\nd", "", None, "x", "x y", "é É z", "w " * 5000, " ", "a b c"]


def test_fingerprints():
    assert simhash.fingerprints_of(TEXTS).tolist() == [slow_print(t) for t in TEXTS]


def test_index_matches_all_pairs():
    random.seed(3)
    for n in (2, 50, 700):
        centres = [random.getrandbits(64) for _ in range(max(1, n // 30))]
        prints = set()
        while len(prints) < n:
            x = random.choice(centres)
            for _ in range(random.randint(0, 5)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
        prints = sorted(prints)
        fp = np.array(prints, np.uint64)
        a, b = simhash.forest(np.zeros(n, np.int64), fp)
        parent = np.arange(n)
        simhash._unite(parent, np.searchsorted(fp, a), np.searchsorted(fp, b))
        assert simhash._roots(parent, np.arange(n)).tolist() == slow_components(prints)
        assert len(a) < n


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, fp int, root int")
    prints = [slow_print(t) for _, t in rows]
    parts = slow_components(prints)
    first = {}
    for (d, _), c in zip(rows, parts):
        first.setdefault(c, []).append(d)
    least = {c: min((d for d in ds if d is not None), default=None) for c, ds in first.items()}
    want = sorted(str((d, p, least[c])) for (d, _), p, c in zip(rows, prints, parts))
    got = sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in simhash.classes(df).collect())
    assert got == want
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    return kept.collect(), least


def test_query_rows(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    kept, least = check(spark, rows)
    assert sorted(r.doc_id for r in kept) == sorted(least.values())
    out = simhash.query(spark, data)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r.doc_id: r.fingerprint for r in out.collect()} == {d: f"{slow_print(t):016x}" for d, t in rows}


def test_edge_rows(spark):
    kept, _ = check(spark, [(k, t) for k, t in enumerate(TEXTS)] + [(None, "lone one here"), (4, "x"), (None, "A b c d")])
    assert [r.text for r in kept if r.doc_id is None] == ["lone one here"]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(df).count() == 0


def test_columns_named_as_locators(spark):
    for names in ("locator_file string, locator_row long", "locator_file string", "locator_row string, locator_row_ string"):
        width = names.count(",") + 1
        rows = [(k, t, *["same" if "long" not in n else 1 for n in names.split(", ")]) for k, t in enumerate(TEXTS)]
        df = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
        kept = simhash.drop_near_copies(df)
        assert kept.columns == df.columns and len(df.columns) == 2 + width
        got = kept.collect()
        assert sorted(r.doc_id for r in got) == sorted(set(slow_components([slow_print(t) for t in TEXTS])))
        assert all(r[2] in ("same", 1) for r in got)
