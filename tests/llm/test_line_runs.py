"""Whole repeated runs of lines against brute force."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("dayloom.llm.registry")

from dayloom.llm import line_dedup
from test_llm import odd, small  # noqa: F401


def brute_runs(rows):
    seen, out = {}, {}
    for i, t in sorted(set(rows)):
        lines = t.encode().split(b"\n")
        gone = set()
        for k in range(len(lines) - 1):
            if seen.setdefault((lines[k], lines[k + 1]), (i, t, k)) != (i, t, k):
                gone |= {k, k + 1}
        out[i, t] = (len(lines), len(gone), b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode())
    return out


def test_lines_of_whole_runs(spark, odd, small):
    # every passage of two to four lines, wherever boundaries fall, is a repeat
    rows = [(i, f"own {i}\n" + "\n".join(f"line {i % 40} {k}" for k in range(2 + i % 40 % 3)) + f"\nend {i}") for i in range(120)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, "u\nv\nw"), (201, "v\nw\nx"), (201, "u\nv"), (202, "u"), (203, None)]
    runs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (odd, small, runs):
        before = [(r.doc_id, r.text or "") for r in df.collect()]
        want = brute_runs([(-(1 << 63) if i is None else i, t) for i, t in before])
        got = line_dedup.dedupe(df.withColumn("was", F.coalesce("text", F.lit(""))), whole_runs=True).collect()
        assert len(got) == len(before)
        if df is not runs:
            assert all((r.n_lines, r.n_removed_lines, r.text) == want[r.doc_id, r.was] for r in got)
    by = {(r.doc_id, r.was): r for r in got}
    assert by[None, "u\nv\nw"].n_removed_lines == 0 and by[200, rows[0][1]].text == "" and by[202, "u"].text == "u"
    assert by[201, "u\nv"].text == "" and by[201, "v\nw\nx"].text == "x"
    assert all(by[i, t].text == f"own {i}\nend {i}" for i, t in rows[40:120])


def test_columns_of_any_name_stay(spark):
    same = "one line of text\nand another line\nand a third line of it\nand a fourth"
    rows = [(1, same, 77, "a", 5), (2, same, 78, "b", 6), (2, same, 79, "c", 7), (None, None, 80, "d", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int, __th string, __gone int")
    df = df.selectExpr("*", "__id as id", "__th as th", "__gone as row", "doc_id as number", "__id as gone")
    out = line_dedup.dedupe(df, whole_runs=True)
    assert out.columns[: len(df.columns)] == df.columns
    got = sorted((tuple(r[c] for c in df.columns if c != "text") for r in out.collect()), key=repr)
    assert got == sorted((tuple(r[c] for c in df.columns if c != "text") for r in df.collect()), key=repr)
    assert {r.text for r in out.filter("doc_id = 2").collect()} != {same}
