"""Stills of clips: places by brute force, several tables of chunks, damaged clips."""

import random

import pytest

from vigilake.sources import clips


@pytest.mark.parametrize("n", [1, 2, 11, 12, 13, 100, 1000])
@pytest.mark.parametrize("a_chunk", [1, 3, 7])
def test_places_of_samples(n, a_chunk):
    random.seed(n)
    parts = [bytes([k % 251]) * random.randrange(50) for k in range(n)]
    raw = clips.packed(parts, a_chunk=a_chunk, wide=n % 2 == 0)
    for most in (1, 5, 12, 50):
        got = list(clips.samples(raw, most))
        assert [g[0] for g in got] == clips.spread(n, min(most, 12)) and len(got) <= 12
        for k, total, seconds, offset, size, is_key in got:
            assert raw[offset : offset + size] == parts[k] and total == n and seconds == k / 25 and is_key == (k % 10 == 0)
    assert got[0][0] == 0 and got[-1][0] == n - 1


def test_damage_gives_an_error_or_whole_stills():
    parts = [bytes([k]) * 20 for k in range(30)]
    raw = clips.packed(parts)
    random.seed(1)
    for _ in range(400):
        bad = bytearray(raw[: random.randrange(len(raw))] if random.random() < 0.5 else raw)
        for _ in range(random.randrange(3)):
            if bad:
                bad[random.randrange(len(bad))] = random.randrange(256)
        rows = list(clips.frames.func().eval(bytes(bad), 12))
        assert 1 <= len(rows) <= 12
        assert all(r[-1] or r[3] + r[4] <= len(bad) for r in rows)


def test_odd_input(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"\x1a\x45\xdf\xa3"), (4, bytearray(clips.packed([b"a", b"bc"]))), (5, bytearray(clips.packed([])))], "id int, content binary")
    rows = df.lateralJoin(clips.frames(clips.F.col("content").outer(), clips.F.lit(12))).collect()
    assert sorted((r.id, r.position, r.error is None) for r in rows if r.id == 4) == [(4, 0, True), (4, 1, True)]
    assert sorted(r.id for r in rows if r.error) == [1, 2, 3, 5]
