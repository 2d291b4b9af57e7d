"""Context mixing: proper probabilities, exact base scores, held-out gain, edge rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from vigilake.llm import lm, mixing


def small_mixer(words):
    c = np.arange(1, len(words) + 1).astype(float)
    counts = np.zeros(256)
    for w, n in zip(words, c):
        for b in w + b" ":
            counts[b] += n
    code = mixing.prefix_code(counts)
    tables = [np.zeros(2 << s, np.float32) for s in mixing.SLOTS]
    bits = mixing.Bits(words, np.zeros(len(words), int), code)
    mixing.count_bits(bits, c, tables)
    mixer = mixing.Mixer.start(code, [mixing.pack_counts(t) for t in tables])
    for _ in range(3):
        mixer.learn(bits, c)
    return mixer


def test_code_is_complete():
    length, bits = mixing.prefix_code(np.arange(256) ** 2)
    assert math.isclose(sum(2.0 ** -length), 1)
    assert len({f"{b:0{n}b}" for n, b in zip(length.tolist(), bits.tolist())}) == 256


def test_probabilities_of_next_byte_sum_to_one():
    mixer = small_mixer([b"the", b"then", b"a", b"", b"\xc3\xa9t\xc3\xa9"])
    for prefix in (b"", b"th", b"zz"):
        # the end mark is the byte 32; a word with any other next byte costs that byte plus its end
        costs = []
        for b in range(256):
            if b == mixing.END:
                words = [prefix]
            else:
                words = [prefix + bytes([b])]
            bits = mixing.Bits(words, np.zeros(1, int), mixer.code)
            at = len(prefix)
            cost = 0.0
            for place, node, bit, slots in bits.depths():
                k = np.flatnonzero(place == at)
                if len(k):
                    x, gate = mixer._look([s[k] for s in slots], 2)
                    mixed = mixer._mixed(x, gate)
                    p, q = mixer._bin(node[k], mixed)
                    seen = mixer.map_counts[p, q]
                    one = 0.5 / (1 + np.exp(-mixed)) + 0.5 * seen[:, 1] / seen.sum(axis=1)
                    one = np.clip(one, 1e-7, 1 - 1e-7)
                    cost -= math.log2(one[0] if bit[k][0] else 1 - one[0])
            costs.append(cost)
        assert math.isclose(sum(2.0**-c for c in costs), 1, rel_tol=1e-5)


def test_counts_pack_exactly_when_small():
    n = np.arange(16).repeat(2).astype(np.float32)
    packed = mixing.pack_counts(n)
    assert (mixing._VALUES[packed & 255] == np.arange(16)).all()
    big = np.array([1e3, 1e6, 5e8, 17.0], np.float32)
    packed = mixing.pack_counts(big).view(np.uint8)
    assert np.allclose(mixing._VALUES[packed], big, rtol=0.07)


def test_classes_depend_on_the_past_only():
    model = lm.class_model(np.random.default_rng(1).random((256, 256)))
    text = "the de la of ein und x y z the the " * 5
    whole, _ = lm.Words([text]).classes(model)
    for n in (1, 7, 30):
        w = lm.Words(["other one", " ".join(text.split()[:n]), ""])
        part, end = w.classes(model)
        assert part[2:].tolist() == whole[:n].tolist()
        assert end[1] == (lm.Words([text]).classes(model)[0][n]) and end[2] == whole[0]


def check(spark, rows, df=None):
    if df is None:
        df = spark.createDataFrame([(d, t, 0.0) for d, t in rows], "doc_id long, text string, score double")
    out = lm.score(df).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = [(d, (t or "").encode().lower().split() + [b""]) for d, t in rows]
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    total, distinct = sum(c.values()), len(c)
    want = sorted(
        (str(d), held(d), len(ws), sum(c[w] > 0 for w in ws), total, math.fsum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws))
        for d, ws in tokens
    )
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-10, atol=1e-6)
    assert all(r.score < 0 and np.isfinite(r.score) for r in out)
    return out


def test_words_of_slices():
    texts = pa.array(["Abc dEf", None, "", "x Y\tz", "É e", "last one"] * 50)
    full = texts.filter(texts.is_valid())
    for whole in (texts, texts.cast(pa.large_string()), full, pa.concat_arrays([full] * 2)):
        for at, n in ((0, 250), (1, 249), (7, 100), (200, 50), (249, 1), (250, 0)):
            part = whole.slice(at, n)
            w = lm.Words(part)
            w.words.validate(full=True)
            want = [(t or "").encode().lower().split() for t in part.to_pylist()]
            assert [[x for x, d in zip(w.words.to_pylist(), w.doc.tolist(), strict=True) if d == k] for k in range(n)] == want
            assert w.raw.tobytes() == b"".join((t or "").encode().lower() for t in part.to_pylist())


def test_lots_are_whole_and_in_order():
    texts = ["a" * 10] * 30 + ["B" * 5000] + [None, ""] + ["c" * 90] * 30
    batch = pa.record_batch({"text": pa.array(texts)})
    lots = list(lm._lots([batch.slice(0, 20), batch.slice(20)], 500))
    assert [t for lot in lots for t in lot.column("text").to_pylist()] == texts and len(lots) > 5
    for lot in lots:
        assert [len(w) for w in lm.Words(lot.column("text")).words.to_pylist()] == [len(t) for t in lot.column("text").to_pylist() if t]


def test_file_of_several_lots(spark, data, tmp_path):
    """One partition whose batches are cut: four lots and more, the last a lone slice, and one batch of over a lot's bytes."""
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").collect()]
    rows = [(d + 10_000 * k, t) for k in range(3) for d, t in given]
    rows.insert(700, (99_999, "Long tale " * 300_000))
    pq.write_table(pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}), f"{tmp_path}/d.parquet")
    df = spark.read.parquet(f"file://{tmp_path}/d.parquet").coalesce(1)
    assert df.rdd.getNumPartitions() == 1
    first, second = check(spark, rows, df), check(spark, rows, df)
    key = lambda rs: sorted((r.doc_id, r.n_tokens, r.base_score, r.score) for r in rs)
    assert [k[:2] for k in key(first)] == [k[:2] for k in key(second)]
    assert np.allclose([k[2:] for k in key(first)], [k[2:] for k in key(second)], rtol=1e-9)


def test_registered_query_reads_the_file(spark, data):
    where = data.replace("0.001", "0.01")
    df = spark.read.parquet(f"{where}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in df.collect()], df)


def test_query_rows(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").collect()]
    held = [r for r in check(spark, rows) if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edge_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "A b\x0bC"), (None, "x" * 70_000), (5, "the the"), (5, "the the"), (7, " é  É ")]
    check(spark, rows)
    monkeypatch.setattr(lm, "HEAVY", 1)  # nearly all words by the join
    check(spark, rows)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def scalar_bits(word, k, code, mixer):
    """Cost of one word in bits, bit by bit with Python numbers."""
    two = 1 << 64
    m, r = [int(x) for x in mixing._M], int(mixing._R)
    raw = [b + 1 for b in word + b" "]
    cost = 0.0
    for at, byte in enumerate(raw):
        b1, b2, b3, b4, b5 = (raw[at - j] if at >= j else 0 for j in range(1, 6))
        whole = sum(raw[i] * pow(r, i, two) for i in range(at)) % two
        c = k + 1
        contexts = [
            ((b1 * m[0] + b2) * m[1] + c) * m[2],
            (((b1 * m[0] + b2) * m[1] + b3) * m[2] + c) * m[3],
            (((((b1 * m[0] + b2) * m[1] + b3) * m[2] + b4) * m[3] + b5) * m[0] + c) * m[1],
            whole * m[2] + min(at, 15),
            (whole * m[0] + c) * m[3],
        ]
        bits = f"{int(code[1][byte - 1]):0{int(code[0][byte - 1])}b}"
        node = 1
        for bit in map(int, bits):
            slots = [((x % two ^ node * m[3] % two) * m[0] % two) >> (64 - s) for x, s in zip(contexts, mixer.sizes)]
            packed = [int(t[s]) for t, s in zip(mixer.tables, slots)]
            x = [float(mixing._STRETCH[p + 2 * 65536]) for p in packed]
            level = [int(mixing._LEVEL[p + 2 * 65536]) for p in packed[2:]]
            gate = (level[1] * mixing.LEVELS + level[2]) * 3 + min(level[0], 2)
            mixed = max(-mixing.LIMIT, min(mixing.LIMIT, sum(float(np.float32(w)) * v for w, v in zip(mixer.weights[gate], x))))
            seen = mixer.map_counts[(node * m[0] % two) >> 54, min(int((mixed / mixing.LIMIT + 1) / 2 * mixing.BINS), mixing.BINS - 1)]
            p = 0.5 / (1 + math.exp(-mixed)) + 0.5 * seen[1] / seen.sum()
            cost -= math.log2(min(1 - 1e-7, max(1e-7, p if bit else 1 - p)))
            node = 2 * node + bit
    return cost


def test_score_by_brute_force(spark, monkeypatch):
    """Exact counts by context, bit by bit; the learned weights are taken from the job."""
    kept = []
    learn = lm.learn_mixer
    monkeypatch.setattr(lm, "learn_mixer", lambda *a: kept.append(learn(*a)) or kept[-1])
    models = []
    survey = lm.survey
    monkeypatch.setattr(lm, "survey", lambda docs: models.append(survey(docs)) or models[-1])
    rows = [(d, t) for d, t in enumerate(["The cat and the dog", "el gato y la casa la", "", None, "the the THE\tcat", "und der Hund, die Katze", "zebra é"] * 2)]
    out = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mixer, (model, code) = kept[0], models[0]
    counts = Counter()
    places = {}
    for d, t in rows:
        w, words = lm.Words([t]), (t or "").encode().lower().split()
        assert [x.as_py() for x in w.words] == words
        shorts, at = [], []
        for word in [*words, b""]:
            at.append(int(np.argmax(model[0] + sum([model[1 + b] for b in shorts], np.zeros(model.shape[1])))))
            if word and len(word) <= lm.SHORT:
                shorts.append(int(w.bucket[len(shorts)]))
        places[d] = list(zip([*words, b""], at))
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(places[d])
    tables = [np.zeros(2 << s, np.float32) for s in mixer.sizes]
    for (word, k), n in sorted(counts.items()):
        mixing.count_bits(mixing.Bits([word], np.array([k]), code, mixer.sizes), np.array([float(n)]), tables)
    assert all((mixing.pack_counts(t) == m).all() for t, m in zip(tables, mixer.tables))
    for d, p in places.items():
        want = -math.log10(2) * sum(scalar_bits(word, k, code, mixer) for word, k in p)
        assert math.isclose(out[d].score, want, rel_tol=1e-4), d


def test_scores_do_not_depend_on_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for partitions, files in ((4, 1), (7, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got.append({r.doc_id: r.score for r in lm.score(docs.repartition(files)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(math.isclose(got[0][d], got[1][d], rel_tol=1e-9) for d in got[0]) and len(got[0]) == len(got[1])


def test_lots_of_long_words_are_small(spark):
    import pyarrow as pa

    words = [b"%07d" % k + b"x" * 100_000 for k in range(50)]
    batch = pa.record_batch([pa.array(words, pa.binary()), *[pa.array(np.ones(50, np.int64))] * lm.CLASSES], names=["word", *[f"c{k}" for k in range(lm.CLASSES)]])
    lots = [w for _, b in lm._blocks([batch]) for _, w, _, _ in lm._by_class(b, "c")]
    assert max(sum(map(len, w)) for w in lots) <= lm.LOT_BYTES + 100_008 and sum(map(len, lots)) == 50 * lm.CLASSES
