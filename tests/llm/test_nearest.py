"""The forest against exact search: recall, depths, groups and blocks, odd vectors."""

from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("dayloom.llm.registry")

from dayloom.llm import nearest

IS_QUERY = "vec_id % 50 = 0"


def brute(rows, k=5):
    by_id = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v):
            by_id[i] = min(by_id.get(i, v), v)
    out = {}
    for i, v in by_id.items():
        if i % 50 == 0:
            v = np.array(v, float)
            c = [(-(v @ np.array(w, float)) / np.sqrt((v @ v) * (np.array(w, float) @ np.array(w, float))), j) for j, w in by_id.items() if j != i and len(w) == len(v)]
            out[i] = sorted((round(s, 12), j) for s, j in c)[:k]
    return out


def answers(df):
    got = defaultdict(list)
    for r in nearest.search(df, IS_QUERY).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(-r.score, 12), r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    return dict(got)


@pytest.mark.parametrize("group,numbers", [(4096, 1 << 20), (100, 64 * 40)])
def test_recall_on_two_thousand_vectors(spark, monkeypatch, group, numbers):
    monkeypatch.setattr(nearest, "GROUP", group)
    monkeypatch.setattr(nearest, "BLOCK_NUMBERS", numbers)  # blocks of 1024 vectors at least
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").repartition(7)
    exact = brute([(r.vec_id, r.embedding) for r in e.collect()])
    got = answers(e)
    assert set(got) == set(exact)
    recall = np.mean([len({v for _, v in exact[q]} & {v for _, v in got[q]}) / 5 for q in exact])
    print("recall", recall)
    assert recall >= 0.9
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 5
        scores = {v: s for s, v in exact[q]}
        assert all(abs(s - scores[v]) < 1e-9 for s, v in found if v in scores)


def test_depths_are_those_of_the_forest(spark, monkeypatch):
    monkeypatch.setattr(nearest, "GROUP", 100)
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    kept = []
    real = nearest._depths

    def depths(*a):
        out = real(*a)
        kept.append((out.collect(), a[3], a[4]))
        return out

    monkeypatch.setattr(nearest, "_depths", depths)
    nearest.candidates(e, IS_QUERY)
    monkeypatch.undo()
    assert kept[0][1] > 0
    rows = sorted((r.vec_id, r.embedding) for r in e.collect())
    unit = np.array([v for _, v in rows])
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    key = nearest.strings(unit)
    share = []
    got = {r.vid: r.depth for r in kept[0][0]}
    for i, (vid, _) in enumerate(rows):
        if vid % 50 == 0:
            counts = [((key >> (nearest.BITS - d)) == (key[i] >> (nearest.BITS - d))).sum() for d in range(nearest.BITS + 1)]
            deepest = max((d for d, c in enumerate(counts) if c >= kept[0][2]), default=0)
            assert got[vid] == deepest
            share.append(((key >> (nearest.BITS - deepest)) == (key[i] >> (nearest.BITS - deepest))).any(axis=1).mean())
    print("share of candidates", np.mean(share))
    assert np.mean(share) < 0.85 and kept[0][2] >= nearest.want(len(rows))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 1.0]), (50, [0.0, 2.0])]
    rows += [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (9, [3.0, 4.0]), (9, [4.0, 3.0]), (100, [1.0, 2.0, 2.0]), (101, [2.0, 1.0, 2.0]), (150, [1.0]), (200, [])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<float>, vid int, ids string, v double")
    got = answers(df)
    want = {q: found for q, found in brute(rows).items() if found}
    assert got == want and [v for _, v in got[0]] == [1, 2, 9, 8, 50]
    assert nearest.search(df.limit(0), IS_QUERY).count() == 0
    assert nearest.search(df.filter("vec_id is null"), IS_QUERY).count() == 0


def test_a_vector_that_many_rows_hold(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, -1.0] if i % 3 == 0 else rng.standard_normal(3).round(3).tolist()) for i in range(600)]
    got = answers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    exact = brute(rows)
    assert {q: v for q, v in got.items() if q % 3 == 0} == {q: v for q, v in exact.items() if q % 3 == 0}
    assert [v for _, v in got[150]] == [0, 3, 6, 9, 12] and [v for _, v in got[0]] == [3, 6, 9, 12, 15]


def test_tiny_and_huge_components(spark):
    """Vectors far from 1 in size take part with their true cosine, whatever their squares do."""
    rows = [(0, [1e-170, 0.0, 1e-171]), (1, [1e200, 0.0, 1e199]), (2, [1.0, 0.0, 0.1]), (3, [0.0, 1e-320, 0.0]), (4, [1e308, 1e308, 1e308]), (50, [3e250, 3e249, 0.0]), (100, [5e-324, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): (r.rank, r.score) for r in nearest.search(df, IS_QUERY).collect()}
    scaled = {i: np.array(v) / max(map(abs, v)) for i, v in rows}
    assert {q for q, _ in got} == {0, 50, 100}
    for q in (0, 50, 100):
        a = scaled[q]
        want = {j: float(a @ b / np.sqrt((a @ a) * (b @ b))) for j, b in scaled.items() if j != q}
        for j, (rank, score) in ((j, x) for (k, j), x in got.items() if k == q):
            assert abs(score - want[j]) < 1e-12
            assert 1 + sum(w > want[j] + 1e-12 for w in want.values()) <= rank <= sum(w >= want[j] - 1e-12 for w in want.values())
    assert got[(0, 1)][1] == pytest.approx(1.0) and got[(0, 2)][1] == pytest.approx(1.0)


def test_recall_in_many_dimensions(spark, monkeypatch):
    """The number of candidates follows measured recall: vectors without structure in 384 dimensions need nearly all, clustered ones few."""
    rng = np.random.default_rng(2)
    enough = []
    real = nearest.enough_for
    monkeypatch.setattr(nearest, "enough_for", lambda *a: enough.append(real(*a)) or enough[-1])
    plain = rng.standard_normal((3000, 384)).round(3)
    clustered = (rng.standard_normal((60, 384))[rng.integers(60, size=3000)] + 0.3 * rng.standard_normal((3000, 384))).round(3)
    for v in (plain, clustered):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
        got = answers(df)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        hits = []
        for q, found in got.items():
            score = unit @ unit[q]
            score[q] = -2
            hits.append(len(set(np.argsort(-score)[:5].tolist()) & {i for _, i in found}) / 5)
        print("recall", np.mean(hits), "enough", enough[-1])
        assert np.mean(hits) >= 0.9
    assert enough[0] > enough[1] == nearest.want(3000)


def test_many_queries_of_one_prefix(spark, monkeypatch):
    """A cluster whose vectors share all bits, queries in it by the hundred: dealt to chunks, each exact."""
    monkeypatch.setattr(nearest, "CHUNK", 20)
    rng = np.random.default_rng(3)
    rows = [(i, (np.array([1.0, 1.0, 1.0]) + 1e-7 * rng.standard_normal(3)).tolist()) for i in range(1500)] + [(10_001 + i, rng.standard_normal(3).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.query_id for r in nearest.search(df, "vec_id % 5 = 0").collect()}
    assert got == {i for i, _ in rows if i % 5 == 0}
