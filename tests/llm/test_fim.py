"""Fill-in-the-middle: Elias-Fano lists by brute force, all contract columns against plain Python, equal digests, edge rows."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from vigilake.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expect(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    p, m = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:p]), "".join(units[p:m]), "".join(units[m:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return str(doc_id), n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 80:
        out, form = f"<S>{suffix}<P>{prefix}<M>{middle}", "spm"
    else:
        out, form = f"<P>{prefix}<S>{suffix}<M>{middle}", "psm"
    return str(doc_id), n, form, len(prefix), len(middle), sha(out), sha(text)


def row(r):
    return str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.back)


def got(df, **more):
    out = fim.transform(df, **more)
    return sorted(map(row, out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()), key=str)


def test_lists_by_brute_force():
    random.seed(3)
    for n, step in ((1, 1), (1, 10**6), (2, 3), (100, 1), (1000, 8), (777, 1000), (5000, 5)):
        ends = np.cumsum([random.randint(1, step) for _ in range(n)])
        code = fim.encode(ends)
        assert [fim.select(i, *code) for i in range(n)] == ends.tolist()
        assert len(code[1]) + len(code[2]) <= n * (2 + max(1, np.log2(ends[-1] / n))) / 8 + 3
    assert fim.encode(np.zeros(0, np.int64)) == (0, b"", b"")


def test_units_by_pattern():
    random.seed(4)
    for _ in range(300):
        text = "".join(random.choice("ab é\t\n\x0b漢 \U0001f600 \x1c") for _ in range(random.randrange(12)))
        ends = np.cumsum([len(u) for u in UNIT.findall(text)]).tolist()
        assert fim.unit_ends(np.frombuffer(text.encode(), np.uint8)).tolist() == ends


EDGE = [(1, None), (2, ""), (3, " "), (None, "a b c"), (None, "a b c"), (5, "has <P> in it"), (6, "<"), (7, "<S"), (8, "M> <P"), (9, "x" * 70_000),
        (10, "w é " * 40_000), (11, "\n\n a \n"), *[(100 + k, "copy of one text, " * 5) for k in range(40)], *[(200 + k, f"t{k} < <P <M" * 3) for k in range(60)]]


def test_edge_rows(spark):
    df = spark.createDataFrame([(t, d, "x") for d, t in EDGE], "text string, doc_id long, list string")
    want = sorted((expect(d, t) for d, t in EDGE), key=str)
    assert got(df) == want
    assert got(df.limit(0)) == []
    # all texts under two digests: no text is taken for a copy of another
    assert got(df, digest=lambda t: F.unhex(F.rpad(F.hex(F.crc32(t.cast("binary")) % 2), 8, "0"))) == want


def test_one_list_for_each_repeated_text(spark):
    df = spark.createDataFrame([(k, "one text " * 9) for k in range(30)] + [(90, "another")], "doc_id long, text string")
    lists = fim.listed(df)
    assert lists.count() == 31 and lists.select("list").distinct().count() == 2
    plan = lists._jdf.queryExecution().toString()
    assert "fim-index" in plan


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    out = fim.query(spark, data)
    assert sorted((tuple([str(r.doc_id), *r[1:]]) for r in out.collect()), key=str) == sorted((expect(r.doc_id, r.text) for r in rows), key=str)
    assert {r.form for r in out.collect()} == {"plain", "spm", "psm"}
