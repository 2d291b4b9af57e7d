"""2.13, ML02, ML04, ML05: a place for image models: any object with labels, the labels that count as explicit, and ``score``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vigilake.operators.media import check_labels

#: Images that a model is given at once.
AT_ONCE = 16
#: Most rows and bytes of a batch that a worker holds; one larger image is a batch of its own.
ROWS, BYTES = 512, 4 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
RESULT = "image_id long, labels array<struct<label: string, value: double>>, fast double, error string"


class Scorer(Protocol):
    """A model: ``score`` gives the labels' shares of each image, or the exception that it met."""

    labels: list[str]
    explicit: list[str]

    def score(self, images: list[bytes]) -> list[dict[str, float] | Exception]: ...


def few_at_once(spark: SparkSession) -> None:
    """Arrow batches of at most ``ROWS`` rows and ``BYTES`` bytes from here on in this session, as a plan's batches are cut when it runs."""
    if not 0 < int(spark.conf.get(_ROWS, "10000")) <= ROWS:
        spark.conf.set(_ROWS, str(ROWS))
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    given = spark.conf.get(_BYTES, None)
    if given is None or not 0 < size(given) <= BYTES:
        spark.conf.set(_BYTES, f"{BYTES}b")


def scored(images: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """Labels, their explicit share and errors of (image_id, content). A task makes its model once.

    A model without its explicit labels is refused before any image. An image that fails has an error and no score; if a whole call
    fails, its images are tried one by one, so that one bad image costs no other. A null image is an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    check_labels(make().labels, make().explicit)
    arrow = to_arrow_schema(images.sparkSession.createDataFrame([], RESULT).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        explicit = check_labels(model.labels, model.explicit)

        def each(content: list[bytes]) -> list[dict[str, float] | Exception]:
            try:
                got = model.score(content)
                if len(got) != len(content):
                    raise ValueError(f"{len(got)} results for {len(content)} images")
                return got
            except Exception as e:  # noqa: BLE001 - any failure of a model is that image's error
                return [e] if len(content) == 1 else [r for c in content for r in each([c])]

        for batch in batches:
            out = []
            for at in range(0, len(batch), AT_ONCE):
                ids, part = (batch.column(c).slice(at, AT_ONCE).to_pylist() for c in ("image_id", "content"))
                results = iter(each([c for c in part if c is not None]))
                for i, c in zip(ids, part, strict=True):
                    r = ValueError("no image") if c is None else next(results)
                    if isinstance(r, Exception):
                        out.append((i, None, None, str(r) or type(r).__name__))
                    else:
                        out.append((i, [{"label": k, "value": float(v)} for k, v in sorted(r.items())], float(sum(r[k] for k in explicit)), None))
            columns = zip(*out, strict=True) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    few_at_once(images.sparkSession)
    return images.select("image_id", "content").mapInArrow(run, RESULT)
