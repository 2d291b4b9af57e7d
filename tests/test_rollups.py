"""Day rollups against counts over all rows, at any hour, in any number of steps."""

import pytest
from pyspark.sql import functions as F

from vigilake.operators import rollups, stats


@pytest.mark.parametrize("as_of", ["2024-01-31 00:00:00", "2024-01-30 23:59:59", "2024-02-02 06:30:00", "2023-12-01 00:00:00", "2024-05-01 12:00:00"])
def test_rollups_equal_the_full_scan(spark, as_of):
    rows = spark.range(4000).selectExpr("id % 7 AS chat_id", "id % 3 = 0 AS deleted", "IF(id % 5 = 0, null, id % 4 = 0) AS banned", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 700) AS created_at")
    kept = rollups.by_day(rows.filter("chat_id < 0"))
    for k in range(3):
        kept = rollups.merged(kept, rollups.by_day(rows.filter(F.col("created_at").cast("string").substr(10, 1).cast("int") % 3 == k)))
    key = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert key(rollups.by_group(kept, rows, as_of)) == key(stats.by_group(rows, as_of))
    assert key(rollups.overall(kept, rows, as_of)) == key(stats.overall(rows, as_of))


def test_rows_of_whole_days_are_not_read(spark, tmp_path):
    rows = spark.range(100).selectExpr("1L AS chat_id", "true AS deleted", "false AS banned", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(int(id), 0, 0, 0) AS created_at")
    rows.write.parquet(f"file://{tmp_path}/d")
    rows = spark.read.parquet(f"file://{tmp_path}/d")
    plan = rollups.by_group(rollups.by_day(rows), rows, "2024-02-10 00:00:00")._jdf.queryExecution().toString()
    assert plan.count("PushedFilters: [Or(") == 1
    assert rollups.merged(rollups.by_day(rows), rollups.by_day(rows.limit(0))).count() == 100
