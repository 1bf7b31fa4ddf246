"""Nearest training rows by cells against all distances, with ties, hot copies, gaps and odd rows."""

import numpy as np
import pytest

from tracegrid.operators import decoding, neighbours


def brute(x, y, folds, embargo, k):
    n = len(x)
    edges = decoding.fold_edges(n, folds)
    pred = {}
    for i in range(n):
        f = np.searchsorted(edges[1:-1], i, side="right")
        t = np.array([j for j in range(n) if not edges[f] - embargo <= j < edges[f + 1] + embargo])
        if len(t):
            d = np.sqrt(((x[i] - x[t]) ** 2).sum(1))
            best = np.lexsort((t, d))[:k]
            d, v = d[best], y[t][best]
            pred[i] = v[d == 0].mean() if (d == 0).any() else (v / d).sum() / (1 / d).sum()
    return pred


def made(kind, n, rng):
    if kind == "line":  # a slow walk: neighbours in time are neighbours in place
        x = np.cumsum(rng.normal(size=(n, 4)), axis=0)
    elif kind == "lattice":  # equal distances everywhere
        x = rng.integers(0, 4, size=(n, 3)).astype(float)
    elif kind == "hot":  # a third of all rows are one vector, others far from the origin
        x = rng.normal(size=(n, 6)) + 1e5
        x[rng.permutation(n)[: n // 3]] = 7.0
    else:
        x = rng.normal(size=(n, 12))
    return x, rng.normal(size=n)


@pytest.mark.parametrize("kind,n,block", [("line", 1500, 64), ("lattice", 1200, 100), ("hot", 1100, 50), ("cloud", 1300, 1024), ("cloud", 7, 4), ("cloud", 1, 4)])
def test_predictions_equal_all_distances(spark, kind, n, block):
    x, y = made(kind, n, np.random.default_rng(n))
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(n)], "pos bigint, v array<double>, y double")
    got = {r.pos: r.pred for r in decoding.knn_oof(df, "v", "y", "pos", n, 5, 3, 15, block).collect()}
    want = brute(x, y, 5, 3, 15)
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-7 * (1 + abs(want[i])) for i in want)


def test_rows_without_value_take_no_part(spark):
    rows = [(0, [0.0, 1.0], 1.0), (1, [0.0, 1.0], None), (2, None, 1.0), (3, [0.0, None], 1.0), (4, [float("nan"), 0.0], 1.0), (5, [float("inf"), 0.0], 1.0), (6, [0.0, 2.0], 5.0), (7, [0.0, 1.0], 3.0)]
    df = spark.createDataFrame(rows, "pos bigint, v array<double>, y double")
    got = {r.pos: r.pred for r in decoding.knn_oof(df, "v", "y", "pos", 8, 2, 0, 3).collect()}
    assert got == {0: 3.0, 6: 1.0, 7: 1.0}
    assert decoding.knn_oof(df.limit(0), "v", "y", "pos", 0).count() == 0


def test_bounds_leave_cells_out_but_none_that_matters():
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=(4000, 2)), axis=0)
    cells = neighbours.Cells(x[::50])
    c, r, m = cells.assigned(x)
    cells.holding([(k, 0, int((c == k).sum()), r[c == k].min(), r[c == k].max(), m[c == k].max()) for k in np.unique(c)], 1, 64)
    count, _, least = cells.bounds(x[:300], np.ones((300, 1), dtype=bool))
    true = np.sqrt(((x[:300, None, :] - x[None, :, :]) ** 2).sum(2))
    for k in np.unique(c):
        assert (least[:, k] <= true[:, c == k].min(axis=1)).all()
    kth = np.sort(true, axis=1)[:, 14]
    assert (least <= kth[:, None]).mean() < 0.2


def test_even_vectors_are_sent_to_few_blocks(spark, monkeypatch):
    """Where the bounds leave nothing out, what is sent is the questions times the blocks: blocks are large."""
    sent, met = [], neighbours._met
    monkeypatch.setattr(neighbours, "_met", lambda asked, *rest: (sent.append(asked.selectExpr("sum(size(asks))").first()[0] or 0), met(asked, *rest))[1])
    x = np.random.default_rng(3).normal(size=(4200, 32))
    df = spark.createDataFrame([(i, v.tolist(), float(i % 5)) for i, v in enumerate(x)], "pos bigint, v array<double>, y double")
    assert decoding.knn_oof(df, "v", "y", "pos", 4200, 5, 5).count() == 4200 and sum(sent) <= 4200
