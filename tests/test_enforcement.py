"""Notices to admins: every pair of a verdict and an admin, and no task with a whole chat."""

from pyspark.sql import functions as F

from vigilake.operators import enforcement


def test_a_chat_with_many_admins_is_spread(spark):
    """one chat's notices were made in one task."""
    schema = "chat_id long, user_id long, message_id long, score double, reasons array<string>, matched boolean, dry_run boolean, done struct<deleted: boolean, banned: boolean, muted: boolean>"
    rows = [(k % 20 // 19, k % 150, k if k % 4 else None, k % 10 / 10, ["text_ad"] if k % 3 else ["bio_link"], k % 7 > 0, k % 11 == 0, (k % 2 == 0, k % 5 == 0, False)) for k in range(2000)]
    targets = spark.createDataFrame([(k % 30 // 29, 1000 + k) for k in range(90)], "chat_id long, admin_id long")
    out = enforcement.admin_notices(spark.createDataFrame(rows + rows[:100], schema), targets)
    want = [
        (c, 1000 + k, u, m, ("dm_notify_text" if r == ["text_ad"] else "dm_notify") + ("" if d else "_kept"), round(s * 100))
        for c, u, m, s, r, matched, dry, (d, b, _) in rows + rows[:100]
        if matched and not dry and (d or b)
        for k in range(90)
        if k % 30 // 29 == c
    ]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(per_task) < len(want) / 4
