"""Models from moments against NumPy on whole tables, and their results on empty ones."""

import numpy as np
import pytest

from tracegrid.operators import decoding, ensembles, linalg, responses, stats
from tracegrid.plans import catalogue, models

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["label"] for r in rows], dtype=np.float64)


def rows_of(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


def test_variances_and_what_is_left(spark, data):
    x, _ = data
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert [r["ratio"] for r in sorted(rows_of(spark, "q37_pca_variance"))] == pytest.approx((s**2 / (s**2).sum()).round(6), abs=2e-6)
    left = {r["k"]: r["error"] for r in rows_of(spark, "q42_recon_error")}
    for k, e in left.items():
        assert e == pytest.approx(((c - c @ vt[:k].T @ vt[:k]) ** 2).sum(), rel=1e-6)
    found = linalg.principal(models.vectors(spark, SF), "v")
    share = np.cumsum(s**2) / (s**2).sum()
    assert linalg.components_for(0.5, found) == int(np.argmax(share >= 0.5)) + 1
    whole = {r["pos"]: r["scores"] for r in linalg.scores(models.vectors(spark, SF), "v", found, ["pos"]).collect()}
    part = {r["pos"]: r["scores"] for r in linalg.scores(models.vectors(spark, SF), "v", found, ["pos"], 3).collect()}
    assert all(np.allclose(whole[p][:3], part[p]) for p in whole)


def test_ridge_out_of_fold(spark, data):
    x, y = data
    n, want = len(y), {}
    edges = [k * (n // 5) for k in range(5)] + [n]
    for f, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        pos = np.arange(n)
        train = (pos < a - 10) | (pos >= b + 10)
        m, s = x[train].mean(0), x[train].std(0)
        z = (x[train] - m) / s
        w = np.linalg.solve(z.T @ z + np.eye(x.shape[1]), z.T @ (y[train] - y[train].mean()))
        pred = (x[a:b] - m) / s @ w + y[train].mean()
        want[f] = 1 - ((y[a:b] - pred) ** 2).sum() / ((y[a:b] - y[a:b].mean()) ** 2).sum()
    assert {r["fold"]: r["r2"] for r in rows_of(spark, "q38_ridge_oof")} == pytest.approx(want, abs=1e-5)


def test_procrustes_logistic_and_residual(spark, data):
    x, y = data
    a, b = x[:, :3] - x[:, :3].mean(0), x[:, 3:6] - x[:, 3:6].mean(0)
    s = np.linalg.svd((a / np.linalg.norm(a)).T @ (b / np.linalg.norm(b)), compute_uv=False).sum()
    assert rows_of(spark, "q43_procrustes")[0]["disparity"] == pytest.approx(1 - s**2, abs=1e-6)
    beta = np.array([r["weight"] for r in sorted(rows_of(spark, "q56_logistic"))])
    p = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
    slope = np.append(x.T @ (p - (y == 0)) + beta[:-1], (p - (y == 0)).sum())  # zero at the optimum
    assert np.abs(slope).max() < 1e-3
    design = np.hstack([x[:, 4:8], np.ones((len(x), 1))])
    w = np.linalg.solve(design.T @ design + np.diag([1e-3] * 4 + [0]), design.T @ x[:, :4])
    got = {r["pos"]: r["left"] for r in rows_of(spark, "q57_residual")}
    assert all(np.allclose(got[k], r, atol=2e-6) for k, r in enumerate(x[:, :4] - design @ w))


def test_factors_lower_the_error_and_left_out_places(spark, data):
    x, _ = data
    errors = [r["error"] for r in sorted(rows_of(spark, "q49_nmf_loss"))]
    assert all(a >= b - 1e-6 for a, b in zip(errors, errors[1:], strict=False)) and errors[-1] < (np.abs(x) ** 2).sum()
    load, off = np.random.default_rng(0).normal(size=(3, x.shape[1])), x.mean(0)
    got = {r["pos"]: r["vector"] for r in linalg.left_out(models.vectors(spark, SF), "v", load, off, ["pos"]).collect()}
    for pos in (0, 7):
        for c in (0, 5):
            rest = np.arange(x.shape[1]) != c
            w = np.linalg.lstsq(load[:, rest].T, (x[pos] - off)[rest], rcond=None)[0]
            assert got[pos][c] == pytest.approx(w @ load[:, c] + off[c], abs=1e-8)


def test_planted_clamp_stays(spark):
    rng = np.random.default_rng(1)
    h = np.abs(rng.normal(size=(2, 6)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.abs(rng.normal(size=(40, 2))) @ h)], "k bigint, v array<double>")
    found, errors = linalg.factorised(df, "v", 2, 15, clamp=h[:1])
    assert np.allclose(found[0], h[0]) and errors[-1] < errors[0]


def test_scrambled_rows_keep_their_values(spark):
    df = spark.createDataFrame([(g, k, float(10 * g + k)) for g in range(3) for k in range(50)], "g int, k bigint, v double")
    one = decoding.scrambled(df, ["g"], "k", ["v"], 1).collect()
    assert sorted((r["g"], r["v"]) for r in one) == sorted((r["g"], r["v"]) for r in df.collect())
    assert sum(r["v"] == 10 * r["g"] + r["k"] for r in one) < 20
    assert sorted(one) == sorted(decoding.scrambled(df.repartition(7), ["g"], "k", ["v"], 1).collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k bigint, v array<double>, w array<double>, y double, pos bigint")
    assert linalg.principal(none, "v").loadings.shape == (0, 0) and linalg.correlations(none, "v").shape == (0, 0)
    assert linalg.residual(none, "v", "w", ["k"]).count() == 0 and len(decoding.logistic(none, "v", "y")) == 0
    assert len(linalg.canonical(none, "v", "w", 2)[0]) == 0 and np.isnan(linalg.procrustes(none, "v", "w"))
    assert linalg.factorised(none, "v", 2, 2)[0].shape == (2, 0)
    assert decoding.ridge_oof(none, "v", ["y"], "pos", 0).count() == 0
    trace = spark.createDataFrame([], "s string, k bigint, y double")
    assert responses.pulses(trace, ["s"], "k", "y").count() == 0 and stats.quantiles(trace, ["s"], "y", [0.5]).count() == 0
    assert stats.levels(trace, "y") == []
    assert ensembles.members(trace.withColumnRenamed("s", "c"), "c", "k", "y", spark.createDataFrame([], "c string, lower double, upper double")).count() == 0


def test_vectors_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        linalg.moments(df, "v")


def test_pulses_by_session(spark):
    """Two sessions with levels of their own: 0 and 1 in one, 5 and 9 in the other."""
    rows = [(s, k, lo + (hi - lo) * (k // 100 % 2)) for s, lo, hi in (("a", 0.0, 1.0), ("b", 5.0, 9.0)) for k in range(1000)]
    found = responses.pulses(spark.createDataFrame(rows, "s string, k bigint, y double"), ["s"], "k", "y", size=5).collect()
    assert sorted((r["s"], r["on"]) for r in found) == [(s, k) for s in "ab" for k in (100, 300, 500, 700, 900)]
