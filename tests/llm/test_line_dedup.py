"""Line deduplication against plain Python and DuckDB, with hot lines decided apart, edge rows and clashing columns."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from vigilake.llm import line_dedup
from vigilake.llm.common import scratch_path

SPACE = " \t\n\x0b\x0c\r"


def expect(rows):
    """Kept text, lines and dropped lines of each row."""
    first = defaultdict(list)
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    norm = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    order = lambda d: (d is None, d or 0)
    for d, ls in lines:
        for x in ls:
            first[norm(x)].append(order(d))
    first = {k: min(v) for k, v in first.items() if len(k) >= 10}
    out = []
    for d, ls in lines:
        kept = [x for x in ls if first.get(norm(x), order(d)) == order(d)]
        out.append((str(d), len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


ROWS = [
    (1, "A common line of text\nunique to one\n\nshort"), (2, "  a COMMON line of text\t\nshort\nshort\nunique to two"), (None, "a common line of text\nnobody's own line"),
    (None, "nobody's own line"), (3, None), (4, ""), (5, "\n"), (6, "twice in one document\nTwice in one document"), (6, "twice in one document"), (7, "twice in one document"),
    (8, "ÄÖÜ ÄÖÜ ÄÖÜ\nnine char\nten  chars"), (9, "äöü ÄÖÜ ÄÖÜ\nnine char\nten  chars\r\nÄÖÜ ÄÖÜ ÄÖÜ"), (10, "x" * 70_000), (11, "X" * 70_000 + "\ntrailing line\n"),
    (12, "\x0btrailing line\x0c"), (13, "a common line of text"), (14, "\n".join(f"line number {k}" for k in range(3000))), (15, "\n".join(f"line number {k}" for k in range(1, 4000, 3))),
    *[(100 + k, f"hot line in every document\nown line {k:06d}") for k in range(300)],
]


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "lines")
    df.write.parquet(f"{path}/documents.parquet")
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.query(spark, path).collect())


@pytest.mark.parametrize("share", [0.0, 1 / 50, 2.0])
def test_small_table(spark, monkeypatch, share):
    """All lines hot (as far as these are few), some, none: the same rows."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    assert got(spark, ROWS) == expect(ROWS)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_hot_lines_take_no_shuffle_of_lines(spark):
    df = line_dedup.located(spark.createDataFrame(ROWS, "doc_id long, text string"))
    lines = line_dedup.materialize(line_dedup.line_hashes(df), "lines")
    assert 1 <= line_dedup.hot_hashes(lines).count() <= line_dedup.HOT
    plan = line_dedup.dropped(lines)._jdf.queryExecution().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan.split("== Physical Plan ==")[1]


def test_texts_keep_their_columns(spark):
    rows = [(t, d, "f", k, 1) for k, (d, t) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "text string, doc_id long, file string, row int, locator_row long")
    out = line_dedup.drop_lines(df)
    assert out.columns == df.columns
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((str(r.doc_id), sha(r.text)) for r in out.collect()) == sorted((d, h) for d, _, _, h in expect(ROWS))
    bits = line_dedup.keep_bitmaps(df).collect()
    assert sum(r.n_dropped for r in bits) == sum(n for _, _, n, _ in expect(ROWS))
    assert all(r.n_dropped > 0 and [w.word for w in r.keep] == sorted({w.word for w in r.keep}) for r in bits)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query(spark, data, size):
    where = data.replace("0.001", size)
    out = line_dedup.query(spark, where)
    rows = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()
    mine = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in out.collect())
    assert mine == expect([(r.doc_id, r.text) for r in rows])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    assert mine == sorted((str(d), n, m, h) for d, n, m, h in con.sql(line_dedup.ORACLE).fetchall())
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString().replace("ArrowParquet", "")
