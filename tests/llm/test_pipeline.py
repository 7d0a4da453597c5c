"""Each stage of the pipeline against a brute-force version of its decision."""

import random
import re
from collections import Counter

import pytest

cp = pytest.importorskip("corpus_pipeline")

from dayloom.llm import near_dup
from dayloom.llm.common import stash
from test_llm import SF, brute_hits, brute_near, texts


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, words = docs.columns, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len(cp.STAGES) == 5
    for k, (_, stage) in enumerate(cp.STAGES):
        before = texts(docs)
        docs = stash(stage(spark, docs, SF), "test")
        if k < 4:
            assert docs.columns == columns
            after = texts(docs)
        if k == 0:
            assert {d for d, _ in before} - {d for d, _ in after} == {d for d, t in before if not any(c.isalpha() for c in t)}
        elif k == 1:
            assert {d for d, _ in after} == {d for d, (_, c) in brute_near(before).items() if c == d}
        elif k == 2:
            assert {d for d, _ in after} == {r[0] for r in brute_hits(before, bench) if not r[5]}
        elif k == 3:
            size, total = dict((d, words(t)) for d, t in before), Counter()
            for d, t in after:
                total[d] += words(t)
            assert all(total[d] <= 2 * size[d] for d in total)
            assert abs(sum(total.values()) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())
        else:
            assert Counter(r.doc_id for r in docs.select("doc_id").collect()) == Counter(d for d, _ in after)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stash(stage(spark, docs, SF), "test")
    assert docs.count() == 0


def test_rows_without_ids_and_texts_under_one_id(spark):
    words = lambda k, n=40: " ".join(f"{'abcdefghij'[(i * k + i // 7) % 10]}{'klmnopq'[(i + k) % 7]}ing" for i in range(n))
    rows = [(None, words(1)), (None, words(2)), (None, words(2)), (7, words(3)), (7, words(4)), (7, words(4)), (8, words(4) + " tail"), (9, None), (9, "")]
    names = ("_id", "_hash", "text_hash", "id", "row", "lang_pred_", "hash")
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or ""), *names) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    columns, want = docs.columns, Counter((i, t) for i, t in rows if t)
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        docs = stash(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        got = docs.collect()
        assert all(r[n] == n for r in got for n in names)
        if k == 0:
            assert Counter((r.doc_id, r.text) for r in got) == want
        elif k in (1, 2):
            assert Counter((r.doc_id, r.text) for r in got) == Counter({x: 1 for x in want if x[0] != 8})
    tokens = cp.tokens(spark, docs, SF)
    assert Counter(r.doc_id for r in tokens.collect()) == Counter(r.doc_id for r in got)


def test_components(spark):
    """Chains, stars and random graphs: every node that isn't a root hangs on the smallest node of its component."""
    rng = random.Random(5)
    graphs = [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(50, i) for i in range(30)], [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]]
    for edges in graphs:
        root = {v: v for e in edges for v in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted((r.node, r.root) for r in got) == sorted((v, r) for v, r in root.items() if v != r)
