"""Hard negatives against exhaustive search."""

import math

import numpy as np
import pytest

from dayloom.llm import hard_negatives


def _plain(rows, anchor=lambda i: i % 100 == 0, negatives=5, positives=5):
    by_id = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        if sum(float(x) * float(x) for x in w) < float(1 << 56):
            by_id[i] = min(by_id.get(i, (label, w)), (label, w))
    out = []
    for i, (label, v) in by_id.items():
        if not anchor(i):
            continue
        score = {j: sum(a * b for a, b in zip(v, w, strict=True)) for j, (_, w) in by_id.items() if j != i and len(w) == len(v)}
        best = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in best if by_id[j][0] == label][:positives]:
            fit = [j for j in best if by_id[j][0] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:negatives]
            out += [(i, p, k + 1, j, score[p], score[j]) for k, j in enumerate(fit)]
    return sorted(out)


def _run(spark, rows, **options):
    df = spark.createDataFrame([(i, label, v, 1) for i, label, v in rows], "vec_id long, label int, embedding array<double>, score int")
    return sorted(tuple(r) for r in hard_negatives.mine(df, "vec_id % 100 = 0" if "is_anchor" not in options else options.pop("is_anchor"), **options).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), rng.normal(0, 1, 4).tolist()) for i in range(401)]
    rows += [(500, None, [1.0] * 4), (501, 1, None), (502, 1, [1.0, None, 1.0, 1.0]), (503, 1, [math.nan] * 4), (504, 1, [math.inf] * 4), (None, 1, [9.0] * 4)]
    rows += [(600, 2, [0.0] * 4), (700, 1, [1.0, 2.0]), (701, 1, [1.0, 2.5]), (702, 0, [1.0, 2.2]), (800, 0, []), (801, 0, []), (802, 1, []), (5, 1, [0.5] * 4), (100, 0, [1e-300, 2.0, 1.0, 0.0])]
    rows += [(900, 1, [1e200] * 4), (901, 1, [3e5, -3e5, 1.0, 0.0]), (902, 2, [3e5, -3e5, 0.9, 0.0]), (1000, 1, [3e5, -3e5, 1.1, 0.5])]
    assert _run(spark, rows) == _plain(rows)


def test_few_rows_and_none(spark):
    assert _run(spark, []) == []
    rows = [(0, 1, [1.0, 0.0])]
    assert _run(spark, rows) == []
    rows += [(1, 1, [1.0, 0.1]), (2, 0, [0.9, 0.0]), (3, 0, [0.95, 0.3]), (100, 1, [-1.0, 0.0])]
    assert _run(spark, rows) == _plain(rows)


@pytest.mark.parametrize("numbers,chunk", [(1 << 20, 2048), (300, 7)])
def test_clusters_shards_and_chunks(spark, monkeypatch, numbers, chunk):
    monkeypatch.setattr(hard_negatives, "NUMBERS", numbers)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 6))
    rows = [(i, int(rng.integers(4)), (centres[i % 12] + rng.normal(0, 0.05, 6)).tolist()) for i in range(2400)]
    anchor = "vec_id % 20 = 0"
    assert _run(spark, rows, is_anchor=anchor) == _plain(rows, lambda i: i % 20 == 0)


def test_copies_and_ties(spark):
    """A third of all rows, anchors too, are one vector; integer components tie."""
    rng = np.random.default_rng(3)
    rows = [(i, 1 if i % 3 == 0 else int(rng.integers(3)), [1.0, 1.0, 0.0] if i % 3 == 0 else (rng.integers(-2, 3, 3) / 2).tolist()) for i in range(1200)]
    assert _run(spark, rows, is_anchor="vec_id % 10 = 0") == _plain(rows, lambda i: i % 10 == 0)


def test_lists_are_left_out(spark):
    """Of well separated clusters few are visited, and the answer stays exact."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(2)), (np.eye(8)[i % 8] * 10 + rng.normal(0, 0.01, 8)).tolist()) for i in range(1600)]
    seen, real = [], hard_negatives._visits

    def visits(asks, lists, home):
        out = real(asks, lists, home)
        seen.append((home, out.count(), asks.count(), int(lists.shards.sum())))
        return out

    hard_negatives._visits = visits
    try:
        assert _run(spark, rows) == _plain(rows)
    finally:
        hard_negatives._visits = real
    rest = sum(n for home, n, _, _ in seen if not home)
    every = sum(asks * (shards - 1) for home, _, asks, shards in seen if not home)
    print("visited", rest, "of", every)
    assert rest < 0.6 * every


def test_options(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 2), rng.normal(0, 1, 3).tolist()) for i in range(300)]
    assert _run(spark, rows, negatives=7, positives=2) == _plain(rows, negatives=7, positives=2)
