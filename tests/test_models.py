"""The place for image models: errors of single images and calls, refused models, one model a task."""

import pytest

from vigilake.operators import models


class Model:
    labels, explicit = ["a", "B"], ["b"]

    def score(self, images):
        if b"all" in images:
            raise RuntimeError("the call failed")
        return [ValueError("bad image") if x == b"bad" else {"a": 0.25, "B": 0.75} for x in images]


class Short(Model):
    def score(self, images):
        return super().score(images)[1:]


def test_errors_stay_with_their_images(spark):
    rows = [(k, bytearray(x) if x is not None else None) for k, x in enumerate([b"x", b"bad", None, b"all", b"", *[b"y"] * 40])]
    df = spark.createDataFrame(rows, "image_id long, content binary").coalesce(1)
    out = {r.image_id: (r.fast, r.error) for r in models.scored(df, Model).collect()}
    assert len(out) == len(rows)
    assert [out[k] for k in range(5)] == [(0.75, None), (None, "bad image"), (None, "no image"), (None, "the call failed"), (0.75, None)]
    assert all(out[k] == (0.75, None) for k in range(5, 45))
    assert models.scored(df.limit(0), Model).count() == 0
    assert {r.error for r in models.scored(df.filter("image_id > 5"), Short).collect()} == {"0 results for 1 images"}


def test_a_model_without_its_labels_is_refused(spark):
    class Other(Model):
        explicit = ["porn"]

    with pytest.raises(ValueError, match="no label"):
        models.scored(spark.createDataFrame([], "image_id long, content binary"), Other)


def test_workers_hold_few_images(spark):
    """batches were of up to 10,000 images."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        df = spark.range(3000).selectExpr("id AS image_id", "cast(repeat('x', 7 + int(id % 5)) AS binary) AS content").coalesce(1)
        out = models.scored(df, Model)
        assert int(spark.conf.get(keys[0])) <= models.ROWS and spark.conf.get(keys[1]) == f"{models.BYTES}b"
        assert out.filter("fast = 0.75 AND error IS NULL").count() == 3000
        spark.conf.set(keys[0], "5")  # a session's own smaller batches stay
        models.scored(df, Model)
        assert spark.conf.get(keys[0]) == "5"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
