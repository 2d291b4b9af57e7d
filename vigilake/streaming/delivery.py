"""SNK09, ST10, DML17: announcements as a stream: paced rows are sent batch by batch, each batch once, and the run's row counts them.

``send`` gets the targets and texts of an Arrow batch and gives an error or None for each. A batch's outcomes are written to
a folder of its number, whose completion (the committed write) says that it was sent: a batch that the engine repeats after
a restart finds them and sends nothing. A batch that was lost before that is sent again, as nothing says what went out.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.operators.state import delivery_failure

OUTCOME = "broadcast_id long, seq long, target long, is_user boolean, second long, error string"
RUN = "broadcast_id long, author_id long, target string, body string, total long"


def outbox(runs: DataFrame, recipients: DataFrame) -> DataFrame:
    """Rows to be sent: each run's text to its recipients (part 0: users, 1: groups; target, seq, second), as its target says: users, groups or all."""
    wanted = (F.col("r.target") == "all") | (F.col("r.target") == F.when(F.col("t.part") == 0, "users").otherwise("groups"))
    rows = recipients.alias("t").join(F.broadcast(runs.alias("r")), wanted)  # an announcement at a time is run: a few rows
    return rows.select("r.broadcast_id", "t.seq", F.col("t.target").alias("target"), (F.col("t.part") == 0).alias("is_user"), "t.second", "r.body")


def open_runs(commands: DataFrame, recipients: DataFrame) -> DataFrame:
    """DML17: run rows with their totals, from confirmed announcements (broadcast_id, author_id, target, body)."""
    sizes = recipients.agg(F.expr("count_if(part = 0)").alias("_users"), F.expr("count_if(part = 1)").alias("_groups"))
    total = F.when(F.col("target") == "users", F.col("_users")).when(F.col("target") == "groups", F.col("_groups")).otherwise(F.col("_users") + F.col("_groups"))
    return commands.crossJoin(F.broadcast(sizes)).withColumn("total", total).drop("_users", "_groups")  # one row of sizes


def sent(rows: DataFrame, send: Callable[[list[int], list[str]], list[str | None]]) -> DataFrame:
    """Outcomes of sending rows of an outbox, in order of their second within each partition."""

    def run(batches):
        for b in batches:
            errors = send(b.column("target").to_pylist(), b.column("body").to_pylist())
            keep = [b.column(c) for c in ("broadcast_id", "seq", "target", "is_user", "second")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(errors, pa.string())], names=["broadcast_id", "seq", "target", "is_user", "second", "error"])

    return rows.sortWithinPartitions("second", "seq").mapInArrow(run, OUTCOME)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a batch's outcomes were written whole, wherever they are stored."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def batch_work(place: str, send: Callable) -> Callable[[DataFrame, int], None]:
    """What is done with each batch of the outbox."""

    def work(rows: DataFrame, number: int) -> None:
        path = f"{place}/sent/batch={number}"
        if not is_done(rows.sparkSession, path):
            sent(rows, send).write.mode("overwrite").parquet(path)

    return work


def deliver(stream: DataFrame, place: str, send: Callable) -> None:
    """Send all rows that a stream of outbox rows has and that weren't sent; goes on from the checkpoint in ``place``."""
    query = stream.writeStream.foreachBatch(batch_work(place, send)).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def outcomes(spark: SparkSession, place: str) -> DataFrame:
    """All outcomes, with what a failure says of its target (X17): users are blocked, groups inactive."""
    rows = spark.read.schema(OUTCOME).parquet(f"{place}/sent/batch=*")
    failure = delivery_failure(F.col("error"))
    mine = F.when(F.col("is_user"), failure == "is_blocked").otherwise(failure == "inactive")
    return rows.withColumn("failure", F.when(mine, failure).when(F.col("error").isNotNull(), "failed"))


def closed_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """DML17: run rows with counts; a run is finished once all its rows have an outcome."""
    counts = results.groupBy("broadcast_id").agg(F.expr("count_if(error IS NULL)").alias("_sent"), F.expr("count_if(error IS NOT NULL)").alias("_failed"))
    joined = runs.join(counts, "broadcast_id", "left")
    done = {"sent": F.coalesce("_sent", F.lit(0)), "failed": F.coalesce("_failed", F.lit(0))}
    return joined.withColumns(done).withColumn("finished", F.col("sent") + F.col("failed") >= F.col("total")).drop("_sent", "_failed")
