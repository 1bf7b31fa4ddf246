"""Sweeps from moments against models that are fitted one by one in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import decoding, sweeps
from tracegrid.operators.decoding import fold_edges

N = 160


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, 6)) + 1e4
    y = x[:, 0] - 0.5 * x[:, 2] + rng.normal(size=N) + np.sin(np.arange(N) / 20)
    z = x[:, 5] * 2 + 0.1 * rng.normal(size=N)
    label = ((x[:, 1] - 1e4) + 0.5 * rng.normal(size=N) > 0).astype(float)
    return x, {"y": y, "z": z, "label": label}


@pytest.fixture(scope="module")
def frame(spark, data):
    x, t = data
    return spark.createDataFrame([(k, [float(v) for v in x[k]], *(float(t[c][k]) for c in t)) for k in range(N)], "pos bigint, v array<double>, y double, z double, label double")


def folds(embargo, n=N, k=5):
    e, pos = fold_edges(n, k), np.arange(n)
    for f, (a, b) in enumerate(zip(e, e[1:], strict=False)):
        yield f, (pos < a - embargo) | (pos > b - 1 + embargo), (pos >= a) & (pos < b)


def ridge(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    w = np.linalg.solve(((x - m) / s).T @ ((x - m) / s) + alpha * np.eye(x.shape[1]), ((x - m) / s).T @ (y - y.mean())) / s
    return lambda q: (q - m) @ w + y.mean()


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_ridge_sweep(frame, data):
    x, t = data
    found = {(r["target"], r["k"], r["embargo"], r["fold"]): r["r2"] for r in sweeps.ridge_sweep(frame, "v", ["y", "z"], "pos", N, [1, 3, 6, 9], 5, [0, 7], 2.0).collect()}
    assert len(found) == 2 * 3 * 2 * 5
    for e in (0, 7):
        for f, train, test in folds(e):
            for name in ("y", "z"):
                for k in (1, 3, 6):
                    want = r2(t[name][test], ridge(x[train, :k], t[name][train], 2.0)(x[test, :k]))
                    assert found[name, k, e, f] == pytest.approx(want, abs=1e-6)


def test_sweeps_odd_rows(spark, frame):
    assert sweeps.ridge_sweep(frame.limit(0), "v", ["y"], "pos", N, [1]).count() == 0
    flat = frame.selectExpr("pos", "v", "1.0 as y", "if(pos = 3, null, z) as z")
    found = sweeps.ridge_sweep(flat, "v", ["y", "z"], "pos", N, [2]).collect()
    assert {r["r2"] is None for r in found if r["target"] == "y"} == {True} and {r["r2"] is None for r in found if r["target"] == "z"} == {False}


def test_decoding_table(frame, data):
    x, t = data
    rows = frame.selectExpr("*", "slice(v, 1, 2) as few")
    found = {(r["embedding"], r["target"]): r for r in sweeps.decoding_table(rows, {"all": "v", "few": "few"}, ["y", "z"], "pos", N, 5, 3).collect()}
    assert len(found) == 4
    own = [r2(t["y"][test], ridge(x[train, :2], t["y"][train], 1.0)(x[test, :2])) for _, train, test in folds(3)]
    assert (found["few", "y"]["mean"], found["few", "y"]["std"], found["few", "y"]["n"]) == pytest.approx((np.mean(own), np.std(own), 5), abs=1e-6)


def test_null_sweep_and_grid(spark, frame, data):
    x, t = data
    moved = {r["pos"]: r for r in sweeps.moved_round(frame, "pos", N, ["y"], 3, 10, 4).collect()}
    for d in range(3):
        row = np.array([moved[k][f"y__{d}"] for k in range(N)])
        shift = next(s for s in range(N) if np.allclose(np.roll(t["y"], s), row))
        assert 10 <= shift < N - 10
    found = sweeps.null_sweep(frame, "v", ["y", "z"], "pos", N, [6], 4).collect()
    assert len(found) == 2 * 5 * 5
    mean = lambda name, real: np.mean([r["r2"] for r in found if r["target"] == name and (r["draw"] < 0) == real])
    assert mean("z", True) > 0.9 and mean("z", False) < 0.2
    grid = {(r["target"], r["sigma"], r["embargo"]): r for r in sweeps.detrend_grid(frame, "v", ["y", "z"], "pos", N, 6, [0.0, 10.0], [0, 5], 5).collect()}
    assert len(grid) == 8
    own = [r2(t["z"][test], ridge(x[train], t["z"][train], 1.0)(x[test])) for _, train, test in folds(5)]
    g = grid["z", 0.0, 5]
    assert g["r2"] == pytest.approx(np.mean(own), abs=1e-6) and g["delta"] == pytest.approx(g["r2"] - g["null"]) and g["p"] == pytest.approx(1 / 6)
    assert grid["z", 10.0, 0]["r2"] != pytest.approx(grid["z", 0.0, 0]["r2"], abs=1e-6)


def logistic(x, y, c):
    x = np.hstack([x, np.ones((len(x), 1))])
    b, pen = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1 / c), 0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * b)
    return b


def auc(y, s):
    a, b = s[y > 0], s[y <= 0]
    return ((a[:, None] > b) + 0.5 * (a[:, None] == b)).mean()


def test_logistic_in_folds(spark, frame, data):
    x, t = data
    rows = frame.selectExpr("pos", "transform(v, q -> q - 1e4) as v", "label", "if(pos < 40, 1.0, label) as some")
    beta = sweeps.logistic_folds(rows, "v", "label", "pos", N, 5, 4, 2.0)
    found = {(r["target"], r["fold"]): r["auc"] for r in sweeps.logistic_auc(rows, "v", ["label", "some"], "pos", N, 5, 4, 2.0).collect()}
    for f, train, test in folds(4):
        b = logistic(x[train] - 1e4, t["label"][train], 2.0)
        assert np.allclose(beta[f], b, atol=1e-6)
        assert found["label", f] == pytest.approx(auc(t["label"][test], (x[test] - 1e4) @ b[:-1] + b[-1]))
    assert found["some", 0] is None  # one label alone
    assert sweeps.logistic_folds(rows.limit(0), "v", "label", "pos", N) == {}


@pytest.mark.parametrize("name", ["ridge", "ridgecv", "pls", "cca", "knn", "logistic"])
def test_decoders(spark, frame, data, name):
    x, t = data
    rows = frame.selectExpr("pos", "transform(v, q -> q - 1e4) as v", "y", "z", "label")
    targets = ["label"] if name == "logistic" else ["y", "z"]
    found = {r["pos"]: r for r in sweeps.decoder(name, "classification" if name == "logistic" else "regression", components=6)(rows, "v", targets, "pos", N, 5, 2).collect()}
    assert sorted(found) == list(range(N))
    made = np.array([found[k][f"pred_{targets[-1]}"] for k in range(N)])
    if name == "logistic":
        assert auc(t["label"], made) > 0.85
    else:
        assert r2(t["z"], made) > (0.5 if name == "knn" else 0.9)
    if name in ("ridge", "pls"):  # six of six latent pairs are the least squares of scaled places
        for _, train, test in folds(2):
            assert np.allclose(made[test], ridge(x[train], t["z"][train], 1.0 if name == "ridge" else 0.0)(x[test]), atol=1e-4)


def test_unknown_decoders():
    with pytest.raises(ValueError, match="decoder"):
        sweeps.decoder("tree")
    with pytest.raises(ValueError, match="task"):
        sweeps.decoder("ridge", "ranking")


def test_in_sample_and_loadings(spark, frame, data):
    x, t = data
    found = {r["pos"]: r for r in sweeps.in_sample(frame, "v", ["y", "z"], "pos", 3.0).collect()}
    assert np.allclose([found[k]["pred_y"] for k in range(N)], ridge(x, t["y"], 3.0)(x), atol=1e-6)
    rows = frame.selectExpr("pos", "transform(v, q -> q - 1e4) as v", "label")
    b = logistic(x - 1e4, t["label"], 1.0)
    made = {r["pos"]: r["pred_label"] for r in sweeps.in_sample(rows, "v", ["label"], "pos", task="classification").collect()}
    assert np.allclose([made[k] for k in range(N)], 1 / (1 + np.exp(-(x - 1e4) @ b[:-1] - b[-1])), atol=1e-6)
    w = sweeps.loadings(frame.selectExpr("slice(v, 1, 2) as e", "array(y, z) as s"), "e", "s", 0.5)
    e, s = x[:, :2] - x[:, :2].mean(0), np.stack([t["y"], t["z"]], axis=1)
    assert np.allclose(w, np.linalg.solve(e.T @ e + 0.5 * np.eye(2), e.T @ (s - s.mean(0))).T, atol=1e-6)


def test_variance_curve(spark, data):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(N, 1)) @ rng.normal(size=(1, 5)) + 0.1 * rng.normal(size=(N, 5))
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(N)], "pos bigint, v array<double>")
    rows = sorted(sweeps.variance_curve(df, "v", "pos", N, 4).collect())
    share = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r["ratio"] for r in rows] == pytest.approx(share / share.sum()) and rows[-1]["cumulative"] == pytest.approx(1)
    assert rows[0]["null_low"] <= rows[0]["null_high"] < rows[0]["ratio"] and rows[-1]["null_low"] == pytest.approx(1)
    assert sweeps.variance_curve(df.limit(0), "v", "pos", N).count() == 0


def test_training_rows_by_moments(frame):
    """What the older sweep of folds gives is what the one pass gives."""
    edges = fold_edges(N)
    old = decoding.training(frame, "v", "pos", edges, 6)
    new = sweeps.fold_moments(frame, "v", "pos", edges, [6])[1]
    assert all(np.allclose(old[f].scatter, new[6, f].scatter) and old[f].n == new[6, f].n for f in old)


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_resampled_means_are_the_hashed_draws(spark, block):
    """Groups of one block and of several, a NULL key and NULL values, against the draws written out as rows; no drawn trial is shuffled."""
    rows = spark.createDataFrame([(u, k, None if k % 11 == 3 else float((k * 37) % 101)) for u, n in ((1, 50), (None, 7), (2, 1)) for k in range(n)], "u bigint, k bigint, x double")
    n = rows.groupBy("u").agg(F.count("*").alias("n"))
    asked = n.selectExpr("u", "n", "explode(sequence(0, 29)) as draw").selectExpr("u", "draw", "n", "explode(sequence(0L, n - 1)) as i").selectExpr("u", "draw", "pmod(xxhash64(5, u, draw, i), n) as k")
    want = asked.alias("a").join(rows.alias("r"), F.expr("a.u <=> r.u and a.k = r.k")).groupBy("a.u", "draw").agg(F.avg("x").alias("m")).collect()
    made = decoding.resampled_means(rows, ["u"], "k", "x", 30, 5, block)
    got = {(r["u"], r["draw"]): r["mean"] for r in made.collect()}
    assert len(got) == len(want) == 90
    for r in want:
        assert got[r["u"], r["draw"]] == (None if r["m"] is None else pytest.approx(r["m"], abs=1e-12))


def test_many_draws_shuffle_no_trials(spark):
    plan = decoding.resampled_means(spark.range(10).selectExpr("id % 2 as u", "id div 2 as k", "double(id) as x"), ["u"], "k", "x", 2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Generate explode") == 1
