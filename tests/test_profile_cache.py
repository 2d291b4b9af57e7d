"""Cache-first scoring: which calls are made, and what a second run and lower thresholds change."""

from pyspark.sql import functions as F

from vigilake.operators import profile_cache as pc

CATEGORIES = ["porn", "hentai"]


def test_only_misses_are_scored_and_once(spark, tmp_path):
    n = iter(range(100))
    calls = {"screen": spark.sparkContext.accumulator(0), "verify": spark.sparkContext.accumulator(0)}

    def write(df):
        path = f"file://{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def counted(name, work, schema):
        def model(rows):
            def run(batches):
                for b in batches:
                    calls[name].add(len(b))
                    yield work(b)

            return rows.mapInPandas(run, schema)

        return model

    # user 5's screening fails, user 6's verification
    fast = {1: 0.2, 2: 0.9, 3: 0.5, 4: 0.95, 5: None, 6: 0.8, 7: 0.1, 8: 0.6}
    screen = counted("screen", lambda b: b.assign(fast=[fast[u] for u in b.user_id]), "user_id long, fingerprint string, fast double")
    label = lambda u: None if u == 6 else [("porn", u / 10), ("Sexy", 0.05)]
    verify = counted("verify", lambda b: b.assign(labels=[label(u) for u in b.user_id]), "user_id long, fingerprint string, labels array<struct<label: string, value: double>>")
    rows = [(u, "f" if u != 7 else "", t, CATEGORIES, g) for g, t in ((1, 0.4), (2, 0.7)) for u in fast] + [(8, "other", 0.4, ["sexy"], 3)]
    requests = spark.createDataFrame(rows, "user_id long, fingerprint string, threshold double, categories array<string>, chat_id long")
    old = [(1, "old", "v3", 0.3, None), (2, "f", "v3", 0.9, [("porn", 0.2)]), (3, "f", "v3", 0.5, None), (4, "f", "v2", 0.1, [("porn", 0.1)])]
    cache = spark.createDataFrame([(*r[:4], "2024-01-01 00:00:00", r[4]) for r in old], pc.CACHE.replace("timestamp_ntz", "string")).withColumn("scanned_at", F.col("scanned_at").cast("timestamp_ntz"))
    now = F.lit("2024-01-31 00:00:00")
    got, after = pc.resolve(requests.filter("chat_id < 3"), cache, screen, verify, "v3", now, write)
    # 2 is verified; 3 was screened under 0.7 but not under 0.4; 7 has no photos
    assert (calls["screen"].value, calls["verify"].value) == (6, 4)
    out = {(r.chat_id, r.user_id): (r.state, r.score) for r in got.collect()}
    assert len(out) == 16
    assert [out[1, u] for u in (1, 2, 3, 4, 5, 7, 8)] == [("screened", 0.2), ("verified", 0.2), ("verified", 0.3), ("verified", 0.4), ("unknown", None), ("unknown", None), ("verified", 0.8)]
    assert out[1, 6] == ("unknown", None) and out[2, 6] == ("unknown", None) and out[2, 3] == ("verified", 0.3)
    kept = {r.user_id: (r.fingerprint, r.fast, r.labels is not None) for r in after.collect()}
    assert kept[1] == ("f", 0.2, False) and kept[4] == ("f", 0.95, True) and kept[6] == ("f", 0.8, False) and 5 not in kept

    fine = requests.filter("chat_id < 3 AND user_id NOT IN (5, 6)")
    before = [c.value for c in calls.values()]
    again, after = pc.resolve(fine, after, screen, verify, "v3", now, write)
    assert [c.value for c in calls.values()] == before  # nothing is scored again
    assert {(r.chat_id, r.user_id): (r.state, r.score) for r in again.collect()} == {k: v for k, v in out.items() if k[1] not in (5, 6)}
    other, after = pc.resolve(requests.filter("chat_id = 3"), after, screen, verify, "v3", now, write)
    assert [c.value for c in calls.values()] == [before[0] + 1, before[1] + 1] and other.first().score == 0.05
