"""Places of rows in a whole order, and results joined to their requests by place, without a window over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: monotonically_increasing_id: bits of the row's number in its partition.
_ROW_BITS = 33


def positions(rows: DataFrame, order: list[Column], write: Callable[[DataFrame], DataFrame], name: str = "position") -> DataFrame:
    """``rows`` with their place from 0 in ``order``: range-partitioned and sorted, numbered in each partition, shifted by the partitions before.

    ``write`` keeps the numbered rows in a table and reads them back, so that both steps see the same partitions. Only the sizes of
    partitions are joined (a row for each). Rows that are equal in ``order`` get any of their places.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    kept = write(sorted_.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", _ROW_BITS)
    sizes = sorted(kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part"])
    before, done = [], 0
    for r in sizes:
        before.append((r["part"], done))
        done += r["n"]
    shifts = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    placed = kept.withColumn("_part", part).join(F.broadcast(shifts), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_part", "_before", "_row")


def zipped(requests: DataFrame, results: DataFrame, request_order: list[Column], result_order: list[Column], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The n-th result belongs to the n-th request. Columns: position, request, result, and ``mismatch``, which says what is missing.

    An empty ``result_order`` takes the results as they come: partition by partition, as a scorer gave them.
    """
    left = positions(requests.select(F.struct("*").alias("request")), [_inside(c, "request", requests) for c in request_order], write)
    right = positions(results.select(F.struct("*").alias("result")), [_inside(c, "result", results) for c in result_order], write)
    both = left.join(right, "position", "full")
    return both.withColumn("mismatch", F.when(F.col("result").isNull(), "no result").when(F.col("request").isNull(), "no request"))


def _inside(column: str | Column, struct: str, rows: DataFrame) -> Column:
    """A column of ``rows`` by name, once it is in a struct."""
    return F.col(f"{struct}.{column}") if isinstance(column, str) else column
