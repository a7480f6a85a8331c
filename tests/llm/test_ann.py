"""Curve neighbours: the curve itself, recall against brute force, ties, copies and unusable rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import ann
from cairn.llm.ann import hilbert, search


@pytest.mark.parametrize(("m", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_to_neighbours(m, bits):
    grid = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * m)], axis=1)
    key = hilbert(grid, bits).astype(int)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        by = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), d[i]) for i in by]
    return out


def collect(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = collect(search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 100 == 0))
    want = brute(rows, range(0, 9000, 100), 10)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(np.sqrt(((x[q].astype(float) - x[i]) ** 2).sum())), rel=1e-12)


@pytest.mark.parametrize("n", [3000, 30000])
def test_bounded_windows_find_neighbours_of_structured_vectors(spark, n):
    """Vectors that vary in few directions need no share of the table: windows of a fixed size reach the recall at either size."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, 48)) + 0.05 * rng.normal(size=(n, 48))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = range(0, n, n // 30)
    got = collect(search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % (n // 30) == 0, least=128, most=128))
    want = brute(rows, asked, 10)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 300, 2)] + [(401, [0.0, 1.0]), (400, [0.0, 1.0]), (403, [0.5, 0.5])]
    odd = [(600, None), (700, [0.0, 0.0]), (800, [nan, 1.0]), (900, [inf, 1.0]), (1000, [None, 1.0]), (1100, []), (1200, [1.0]), (None, [1.0, 1.0]), (400, [0.0, 1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    got = collect(search(frame, F.col("id") % 100 == 0, k=3))
    want = brute(rows, [0, 100, 200, 400], 3)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert search(frame.limit(0), F.col("id") % 100 == 0).collect() == []
    assert collect(search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>"), F.col("id") % 100 == 0)) == {0: [(1, 1.0)]}
