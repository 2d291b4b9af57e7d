"""Near copies against brute force: planted edits, a large family, pairs just under the similarity, edge rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigilake.llm import near_copies, simhash


def similar_pairs(texts, least=0.8):
    """All pairs of a similarity of ``least`` or more, by shared shingles."""
    sets = [frozenset(simhash.hashes(t, 5)) for t in texts]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s:
            where[h].append(i)
    shared = Counter((a, b) for l in where.values() for k, b in enumerate(l) for a in l[:k])
    empty = [i for i, s in enumerate(sets) if not s]
    pairs = [(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= least]
    return pairs + [(empty[0], x) for x in empty[1:]]


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def edited(words, share, vocabulary):
    return " ".join(random.choice(vocabulary) if random.random() < share else w for w in words)


@pytest.fixture(scope="module")
def planted():
    random.seed(9)
    vocabulary = [f"w{random.randrange(10**6)}" for _ in range(3000)] + ["the", "of", "and", "to"] * 200
    texts = [" ".join(random.choices(vocabulary, k=random.choice((40, 120, 400)))) for _ in range(300)]
    for _ in range(100):  # copies with edits at several rates: some over the similarity, some under
        texts.append(edited(random.choice(texts[:300]).split(), random.choice((0.005, 0.015, 0.03)), vocabulary))
    base = random.choices(vocabulary, k=200)
    texts += [edited(base, 0.01, vocabulary) for _ in range(150)]  # one family
    texts += ["", None, "  ", "short text", "Short  TEXT", "short text again"]
    return texts


def test_recall_and_precision(spark, planted):
    df = spark.createDataFrame([(t, k) for k, t in enumerate(planted)], "text string, doc_id long")
    label = {r.doc_id: r.label for r in near_copies.classes(near_copies.located(df)).collect()}
    pairs = similar_pairs(planted)
    root = components(len(planted), pairs)
    # links are exact: rows of one label are of one component
    assert len({(label[d], root[d]) for d in label}) == len(set(label.values()))
    missed = sum(label[a] != label[b] for a, b in pairs)
    assert len(pairs) > 1000 and missed <= 0.02 * len(pairs)
    lone = [(a, b) for a, b in pairs if max(a, b) < 400]  # outside the family, where one missed link isn't made good by others
    assert len(lone) > 20 and sum(label[a] != label[b] for a, b in lone) <= 0.1 * len(lone)
    assert max(Counter(root).values()) > 100


def test_similarity():
    import pyarrow as pa

    a, b = "one two three four five six seven", "One two three four five six eight"
    got = near_copies.similarity.func(pa.array([a, a, None, "x"]), pa.array([a, b, None, ""])).to_pylist()
    assert got == [1.0, 2 / 4, 1.0, 0.0]


def test_shingles_by_brute_force():
    """Equal hashes for equal shingles only, whatever stands around a text."""
    import pyarrow as pa

    random.seed(5)
    texts = ["".join(random.choice("aB é\n\t漢x \x0b ") for _ in range(random.randrange(60))) for _ in range(300)] + ["", None, "  ", "x" * 3000, "one", "One two", " one  two three four five six"]
    seen = {}
    for at in (0, 1, 250):
        words, count = near_copies.word_hashes(pa.array(texts).slice(at))
        for size in (1, 2, 5):
            flat, n = near_copies.shingles(words, count, size)
            for t, mine in zip(texts[at:], np.split(flat, np.cumsum(n)[:-1]), strict=True):
                w = (t or "").encode().lower().split()
                want = [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
                assert len(want) == len(mine)
                for x, h in zip(want, mine.tolist(), strict=True):
                    assert seen.setdefault((size, x), h) == h
    assert len({(k[0], h) for k, h in seen.items()}) == len(seen)


def test_neighbours_by_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(8)])
    group, id_ = rng.integers(0, 3, len(fp)), rng.permutation(len(fp))
    n, label = rng.integers(8, 13, len(fp)), rng.integers(0, 100, len(fp))
    for k, again in ((1, np.ones(len(fp), bool)), (3, rng.random(len(fp)) < 0.3), (50, group == 1)):
        a, b, d, many = near_copies.neighbours(group, id_, fp, n, label, again, k)
        got = defaultdict(list)
        for x, y, z, m in zip(a.tolist(), b.tolist(), d.tolist(), many.tolist(), strict=True):
            got[x].append((z, y))
        for i in range(len(fp)):
            want = sorted(
                (int(fp[i] ^ fp[j]).bit_count(), int(id_[j]))
                for j in range(len(fp))
                if i != j and again[i] and group[i] == group[j] and label[i] != label[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and int(fp[i] ^ fp[j]).bit_count() <= near_copies.RADIUS
            )
            assert sorted(got[id_[i]]) == want[:k]
            assert all(m == (len(want) >= k) for x, m in zip(a.tolist(), many.tolist(), strict=True) if x == id_[i])


def test_family_under_the_similarity(spark, monkeypatch):
    """Texts of one family that are too different to be linked name few of each other, and no link is lost."""
    random.seed(4)
    vocabulary = [f"w{random.randrange(10**6)}" for _ in range(3000)]
    base = random.choices(vocabulary, k=400)
    texts = [edited(base, 0.06, vocabulary) for _ in range(150)] + [edited(base, 0.004, vocabulary) for _ in range(20)]
    named, real = [], near_copies.candidates

    def counted(*args):
        named.append(near_copies.materialize(real(*args), "counted"))
        return named[-1]

    monkeypatch.setattr(near_copies, "candidates", counted)
    df = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text string, doc_id long")
    label = {r.doc_id: r.label for r in near_copies.classes(near_copies.located(df)).collect()}
    root = components(len(texts), similar_pairs(texts))
    assert len({(label[d], root[d]) for d in label}) == len(set(label.values())) == len(set(root))
    # 14,365 pairs, of which many lie within the radius
    assert sum(x.count() for x in named) <= 12 * len(texts)


def test_pairs_are_named_once():
    """Over all tables, every pair that shares a group of any and has near sketches, whatever its fingerprints' distance within the radius."""
    import pyarrow as pa

    random.seed(6)
    base = [f"w{k}" for k in range(120)]
    texts = [edited(base, share, ["x", "y", "z"]) for share in (0, 0.005, 0.01, 0.02, 0.05, 0.1) for _ in range(12)]
    words, count = near_copies.word_hashes(pa.array(texts))
    sketch = near_copies.sketches(words, count)
    flat, n = near_copies.shingles(words, count, near_copies.WORDS)
    sets = [set(x.tolist()) for x in np.split(flat, np.cumsum(n)[:-1])]
    fp = simhash.majority(*near_copies.shingles(words, count, near_copies.INDEX_WORDS))
    size, ids = np.array([len(x) for x in sets]), np.arange(len(texts))
    got = []
    keys = [sum(((fp >> p) & np.uint64(1)).astype(np.int64) << k for k, p in enumerate(bits)) | t << near_copies.BITS for t, bits in enumerate(near_copies.sampled_bits())]
    for key in keys:
        named = near_copies.neighbours(key, ids, fp, size, ids, np.ones(len(ids), bool), 1000, sketch.view(np.uint64))
        a, b, *_ = near_copies._once(*named)
        got += zip(a.to_pylist(), b.to_pylist(), strict=True)
    want = set()
    for i in ids.tolist():
        for j in range(i + 1, len(ids)):
            apart = int(np.bitwise_count(sketch[i] ^ sketch[j]).sum())
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert abs(apart / near_copies.SKETCH - (1 - alike) / 2) < 0.08
            assert alike < 0.8 or apart <= near_copies.MOST
            near = int(fp[i] ^ fp[j]).bit_count() <= near_copies.RADIUS and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])
            if apart <= near_copies.MOST and near and any(key[i] == key[j] for key in keys):
                want.add((i, j))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_edge_rows(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, None), (8, ""), (9, "x" * 60_000), (10, "X" * 60_000), (11, "other words stand here now")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, locator_row int")
    out = near_copies.drop_near_copies(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["11", "4", "7", "9"]
    assert near_copies.drop_near_copies(df.limit(0)).count() == 0
