"""Terms of entities that stand in few texts, against exact probabilities."""

import re
from collections import defaultdict

import pytest

pytest.importorskip("dayloom.llm.registry")

from dayloom.llm import pii
from test_llm import PATTERNS, valid


def brute_terms(rows, alpha=0.9, level=0.01):
    """The disclosing terms of each different text, from exact probabilities."""
    from math import comb, log2

    kinds = {k: re.compile(p) for k, p in PATTERNS.items()}
    distinct = set(rows)
    words = {t: {w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")} for t in distinct}
    entities, holds = defaultdict(set), defaultdict(set)
    for t in distinct:
        for k, p in kinds.items():
            for m in p.finditer(t or ""):
                if valid(k, m.group()):
                    entities[k, m.group()].add(t)
        for w in words[t]:
            holds[w].add(t)
    n, out = len(distinct), defaultdict(set)
    for at in entities.values():
        for w in set().union(*(words[t] for t in at)):
            k, e, h = len(at & holds[w]), len(at), len(holds[w])
            if h * e < n * k and log2(n * k / (h * e)) >= alpha * log2(n / e) - 1e-9 and comb(e, k) * comb(h, k) / comb(n, k) <= level:
                for t in at & holds[w]:
                    out[t].add(w)
    return out


def test_disclosing_terms_of_entities_in_one_or_two_texts(spark):
    far = "the usual words of all texts " * 8
    rows = [f"the usual words of all texts number {i}" for i in range(150)]
    rows += [f"Bo {far}writes R2D2 from bo@one.example with 王小明 and all"]
    rows += [f"the usual words {far}two@two.example {far}Kestrel7 {i}" for i in ("x", "y")]
    rows += ["the usual words 10.1.2.3 of all texts", "the usual words 10.1.2.3 of all texts", None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute_terms(rows)
    got = {r.doc_id: r.term for r in pii.spans(df).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        base = [m.span() for p in PATTERNS.values() for m in re.finditer(p, t or "")]
        words = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") if m.group().lower() in want[t]]
        assert [(x.start, x.end) for x in got[i]] == [m.span() for m in words if not any(a < m.end() and m.start() < b for a, b in base)]
    assert [x.value for x in got[150]] == ["Bo", "writes", "R2D2", "from", "with", "王小明", "and"]
    assert "Kestrel7" in [x.value for x in got[151]] and "Kestrel7" in [x.value for x in got[152]]


def test_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"user{i}@mail{i}.example +1 555 {1000000 + i} 10.0.{i % 256}.{i % 200}" for i in range(32_000))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.find(df).collect()}
    took = time.perf_counter() - began
    for kind, pattern in PATTERNS.items():
        want = [m.span() for m in re.finditer(pattern, text) if valid(kind, m.group())]
        assert [(x.start, x.end) for x in got[1][kind]] == want and not got[2][kind]
    assert took < 60
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[2] is None and clean[1].count("[EMAIL]") == 32_000 and "@" not in clean[1]


def brute_query(rows):
    import hashlib

    want, out = brute_terms([t for _, t in rows]), []
    for i, t in rows:
        spans = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        words = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") if m.group().lower() in want[t]]
        terms = [("term", *m.span()) for m in words if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        shown = lambda some: ",".join(f"{k}:{a}:{b}" for k, a, b in some)
        out.append((i, *(sum(k == s[0] for s in spans) for k in PATTERNS), hashlib.sha256(shown(spans).encode()).hexdigest(), shown(spans + terms)))
    return sorted(out)


def test_query_against_brute_force(spark):
    docs = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{docs}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in pii.op4(spark, docs).collect())
    assert got == brute_query(rows)
    assert sum(g[-1].count("term") for g in got) > 0


def test_sanitise_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a@b.example now", 7, "x", 3), (1, "other", 8, "y", 4), (None, "ip 1.2.3.4", 9, "z", 5), (None, None, 1, "q", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, text_hash string, row int")
    got = sorted((tuple(r) for r in pii.sanitise(df).collect()), key=str)
    want = [(1, "mail [EMAIL] now", 7, "x", 3), (1, "other", 8, "y", 4), (None, "ip [IP]", 9, "z", 5), (None, None, 1, "q", 6)]
    assert got == sorted(want, key=str)
