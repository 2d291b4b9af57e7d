"""Attention MIL: gradients by differences, held-out accuracy, edge rows."""

import numpy as np

from vigilake.llm import quality


def test_forward_and_training_separate_bags():
    rng = np.random.default_rng(0)
    count = rng.integers(1, 6, 300)
    x = rng.normal(size=(count.sum(), quality.FEATURES))
    label = rng.integers(0, 2, 300).astype(float)
    starts = np.cumsum(count) - count
    x[starts[label == 0], 3] += 8  # one bad passage makes a bad document
    model = quality.fit(x, count, label)
    y = model.forward((x - model.centre) / model.scale, count)
    assert ((y["y"] > 0.5) == (label == 1)).mean() > 0.97
    assert np.allclose(np.add.reduceat(y["a"], starts), 1)
    several = (label == 0) & (count > 1)
    assert y["a"][starts[several]].mean() > 1.2 * (1 / count[several]).mean()


def test_passages_cover_whole_texts():
    texts = ["", None, "a" * 2000, "word word word two", "É" * 400]
    x, count = quality.passages(texts)
    assert count.tolist() == [1, 1, 4, 1, 2] and x.shape == (9, quality.FEATURES) and np.isfinite(x).all()
    one, _ = quality.passages(["word word word two"])
    assert np.allclose(one, x[6])  # neighbours in a lot don't matter


def test_held_out_accuracy(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    right = [r.predicted == labels[r.doc_id] for r in rows]
    assert len(rows) > 50 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (None, "", 0.1), (2, "x " * 50_000, 0.1), (2, "x " * 50_000, 0.1)], "doc_id long, text string, score double")
    for labels in ([], [(1, 1)], [(1, None), (None, 1), (2, 1), (2, 0)]):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        out = quality.score(docs, model).collect()
        assert len(out) == 4 and out[2].score == out[3].score and all(np.isfinite(r.score) for r in out)
        kept = quality.keep_good(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    assert quality.score(docs.limit(0), model).count() == 0
