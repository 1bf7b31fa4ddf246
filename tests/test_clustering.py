"""Linkage, leaf order, distances and levels against plain computations."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import clustering, ensembles, linalg


def vectors(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "frame bigint, v array<double>")


def merged_plainly(points, dist, method):
    """(height, members) of each merge, by looking at all pairs of clusters each time."""
    open_, out = [[k] for k in range(len(dist))], []

    def far(a, b):
        sub = dist[np.ix_(a, b)]
        if method == "ward":
            return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(points[a].mean(0) - points[b].mean(0))
        return {"average": sub.mean, "complete": sub.max, "single": sub.min}[method]()

    while len(open_) > 1:
        a, b = min(combinations(range(len(open_)), 2), key=lambda p: far(open_[p[0]], open_[p[1]]))
        out.append((far(open_[a], open_[b]), sorted(open_[a] + open_[b])))
        open_ = [c for k, c in enumerate(open_) if k not in (a, b)] + [out[-1][1]]
    return out


@pytest.mark.parametrize("method", ["ward", "average", "complete", "single"])
def test_linkage(method):
    points = np.random.default_rng(1).normal(size=(35, 3))
    dist = np.linalg.norm(points[:, None] - points[None], axis=-1)
    merges, want = clustering.linkage(dist, method), merged_plainly(points, dist, method)
    inside = {k: [k] for k in range(35)}
    for k, (a, b, h, n) in enumerate(merges):
        inside[35 + k] = sorted(inside[int(a)] + inside[int(b)])
        assert h == pytest.approx(want[k][0]) and inside[35 + k] == want[k][1] and n == len(want[k][1])
    labels, order = clustering.labelled(merges, 6), clustering.leaf_order(merges)
    assert len(set(labels)) == 6 and sorted(order) == list(range(35))
    for c in set(labels):  # a cluster's leaves stand side by side
        at = sorted(order.index(k) for k in range(35) if labels[k] == c)
        assert at == list(range(at[0], at[0] + len(at)))


def test_few_cells():
    assert clustering.labelled(clustering.linkage(np.zeros((1, 1))), 3) == [1] and clustering.leaf_order(clustering.linkage(np.zeros((1, 1)))) == [0]
    assert clustering.labelled(clustering.linkage(np.zeros((4, 4))), 1) == [1] * 4


def test_distances(spark):
    x = np.abs(np.random.default_rng(2).normal(size=(50, 6))) + 1e6 * 0
    x[:, 3] = 0.0
    df = vectors(spark, x)
    assert np.allclose(clustering.distances(df, "v"), np.linalg.norm(x.T[:, None] - x.T[None], axis=-1))
    assert np.allclose(clustering.distances(vectors(spark, x + 1e8), "v"), np.linalg.norm(x.T[:, None] - x.T[None], axis=-1), atol=1e-5)
    c = np.corrcoef(x[:, [0, 1, 2, 4, 5]].T)
    found = clustering.distances(df, "v", "correlation")
    assert np.allclose(found[np.ix_([0, 1, 2, 4, 5], [0, 1, 2, 4, 5])], 1 - c) and found[3, 0] == 1.0
    u = x[:, :3] / np.linalg.norm(x[:, :3], axis=0)
    assert np.allclose(clustering.distances(df, "v", "cosine")[:3, :3], 1 - u.T @ u)
    p = x[:, [0, 1]] / x[:, [0, 1]].sum(axis=0)
    kl = lambda a, b: float((a * np.log(a / b)).sum())
    assert clustering.distances(df, "v", "kl")[0, 1] == pytest.approx(kl(p[:, 0], p[:, 1]) + kl(p[:, 1], p[:, 0]), rel=1e-6)
    mid = p.mean(axis=1)
    assert clustering.distances(df, "v", "jsd")[0, 1] == pytest.approx(math.sqrt((kl(p[:, 0], mid) + kl(p[:, 1], mid)) / 2), rel=1e-9)
    assert clustering.distances(df.limit(0), "v").shape == (0, 0)


def best_levels(values, k):
    """The least sum of squares over all ways to cut the sorted values."""
    v = np.sort(values)
    cost = lambda cut: sum(((part - part.mean()) ** 2).sum() for part in np.split(v, cut))
    cut = min(combinations(range(1, len(v)), k - 1), key=cost)
    return [part.mean() for part in np.split(v, cut)]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_levels(spark, k):
    rng = np.random.default_rng(k)
    values = np.round(np.concatenate([rng.normal(c, 0.3, 9) for c in (0, 2, 5)]), 2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    found = clustering.levels(df, "x", k)
    assert found == pytest.approx(best_levels(values, k))
    assert [r[0] for r in df.where("x < 0.1").limit(1).select(clustering.nearest_level(F.col("x"), found)).collect()] == [0]


def test_levels_of_few_or_many_values(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (4.0,)], "x double")
    assert clustering.levels(df, "x", 2) == [1.0, 4.0] == clustering.levels(df, "x", 3)
    assert clustering.levels(df.limit(0), "x", 2) == [] == clustering.levels(df.limit(0), "x", 3)
    with pytest.raises(ValueError, match="distinct"):
        clustering.levels(spark.range(50).selectExpr("id * 1.0 as x"), "x", 3, most=20)
    many = np.random.default_rng(0).normal(size=5000) + np.repeat([0, 4], 2500)
    v = np.sort(many)
    s, n = np.cumsum(v - v.mean())[:-1], np.arange(1, 5000)
    at = int((s * s / n + s * s / (5000 - n)).argmax()) + 1
    assert clustering.levels(spark.createDataFrame([(float(x),) for x in many], "x double"), "x", 2) == pytest.approx([v[:at].mean(), v[at:].mean()])


def test_extracted_clusters(spark):
    """Two groups of cells that go together, and cells that go with nothing."""
    rng = np.random.default_rng(7)
    drive = (rng.random((400, 2)) < 0.1) * 3.0
    x = np.hstack([drive[:, [0]] + 0.2 * rng.normal(size=(400, 5)), drive[:, [1]] + 0.2 * rng.normal(size=(400, 4)), rng.normal(size=(400, 3))])
    rows = vectors(spark, x)
    null = [vectors(spark, np.stack([np.roll(c, int(rng.integers(400))) for c in x.T], axis=1)) for _ in range(6)]
    found = linalg.principal(rows, "v", 2)
    loads = spark.createDataFrame([(c, j, float(found.loadings[c, j])) for c in range(2) for j in range(12)], "comp bigint, cell bigint, value double")
    scores = linalg.scores(rows, "v", found, ["frame"], 2).select("frame", F.posexplode("scores").alias("comp", "value"))
    cells, active = clustering.extract_clusters(rows, null, "v", loads, scores, 2, sigma=2.0)
    got = {r["cell"]: r["cluster"] for r in cells.collect()}
    assert len({got[c] for c in range(5)}) == 1 and len({got[c] for c in range(5, 9)}) == 1 and {got[0], got[5]} == {1, 2}
    assert sum(got[c] == 0 for c in (9, 10, 11)) >= 2
    when = {k: {r["frame"] for r in active.where(f"active and cluster = {got[c]}").collect()} for k, c in enumerate((0, 5))}
    assert all(len(when[k] & set(np.flatnonzero(drive[:, k]).tolist())) > 0.6 * (drive[:, k] > 0).sum() for k in (0, 1))
    assert ensembles.sizes(cells.where("cluster > 0"), cells.where("cluster > 0"), "cluster").count() == 2
