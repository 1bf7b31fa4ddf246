"""Factors under their losses and penalties, sparse components, and cross-validated errors, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import factors, linalg


def vectors(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "pos bigint, v array<double>")


@pytest.fixture(scope="module")
def parts():
    rng = np.random.default_rng(1)
    return rng.gamma(1.0, size=(120, 3)) @ rng.gamma(1.0, size=(3, 9)) + 0.01


@pytest.mark.parametrize("loss", factors.LOSSES)
def test_losses_fall(spark, parts, loss):
    fit = factors.nmf(vectors(spark, parts), "v", 3, loss, rounds=25, inner=80, tol=0.0)
    assert all(b <= a * (1 + 1e-6) for a, b in zip(fit.losses, fit.losses[1:], strict=False))
    assert fit.losses[-1] < 0.05 * fit.losses[0] and (fit.h >= 0).all()
    w = factors.row_weights(parts, fit.h, loss, 80)
    assert factors.loss_of(parts, w @ fit.h, loss) <= fit.losses[-1] * (1 + 1e-6)
    rows = {r["pos"]: r for r in factors.scored(vectors(spark, parts), "v", fit, ["pos"], loss, 80).collect()}
    assert np.allclose(rows[5]["vector"], w[5] @ fit.h)


def test_losses_against_their_formulas():
    rng = np.random.default_rng(2)
    x, y = rng.gamma(1.0, size=(4, 3)) + 0.1, rng.gamma(1.0, size=(4, 3)) + 0.1
    assert factors.loss_of(x, y, "frobenius") == pytest.approx(0.5 * ((x - y) ** 2).sum())
    assert factors.loss_of(x, y, "kullback-leibler") == pytest.approx((x * np.log(x / y) - x + y).sum())
    assert factors.loss_of(x, y, "itakura-saito") == pytest.approx((x / y - np.log(x / y) - 1).sum())


def test_tolerance_and_fits_that_share_passes(spark, parts):
    df = vectors(spark, parts).withColumn("g", F.when(F.col("pos") < 60, F.array(F.lit(1).cast("bigint"))).otherwise(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    starts = {1: factors.start(parts.mean(0), 2, 3), 2: factors.start(parts.mean(0), 3, 4)}
    both = factors.non_negative(df, "v", starts, "g", rounds=6, tol=0.0)
    alone = factors.non_negative(vectors(spark, parts[60:]), "v", {2: starts[2]}, rounds=6, tol=0.0)
    assert np.allclose(both[2].h, alone[2].h) and both[2].losses == pytest.approx(alone[2].losses)
    soon = factors.non_negative(df, "v", starts, "g", rounds=50, tol=0.05)
    assert len(soon[1].losses) < 50
    kept = factors.non_negative(df, "v", starts, "g", rounds=3, fixed=1)
    assert np.allclose(kept[1].h[0], starts[1][0]) and not np.allclose(kept[1].h[1], starts[1][1])


def test_odd_values(spark):
    df = spark.createDataFrame([(0, [1.0, None]), (1, [float("nan"), 2.0]), (2, [-3.0, 1.0]), (3, None)], "pos bigint, v array<double>")
    fit = factors.nmf(df, "v", 1, "kullback-leibler", rounds=4)
    assert np.isfinite(fit.h).all() and np.isfinite(fit.losses).all()
    assert factors.nmf(df.limit(0), "v", 2).h.shape == (2, 0)
    with pytest.raises(ValueError, match="loss"):
        factors.nmf(df, "v", 1, "other")


def test_penalised_columns():
    """Coordinate descent meets the conditions of the optimum: no slope where a place is in use, a slope within the lasso where it is not."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 8))
    gram, cross = a.T @ a / 40, a.T @ rng.normal(size=(40, 3)) / 4
    b = factors.penalised(gram, cross, 0.3, 0.1)
    slope = gram @ b - cross + 0.1 * b
    used = np.abs(b) > 0
    assert np.allclose(slope[used], -0.3 * np.sign(b[used]), atol=1e-7) and (np.abs(slope[~used]) <= 0.3 + 1e-9).all() and 0 < used.sum() < used.size


def test_elastic_net_factors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 3)) @ (rng.normal(size=(3, 8)) * (rng.random((3, 8)) < 0.5)) + 0.05 * rng.normal(size=(150, 8))
    fit = factors.elastic_net(vectors(spark, x), "v", 3, 0.5, 0.7, rounds=15)
    assert all(b <= a + 1e-9 for a, b in zip(fit.losses, fit.losses[1:], strict=False)) and fit.losses[-1] < fit.losses[0]
    lasso, ridge = 0.35, 0.15
    w = factors.penalised(fit.h @ fit.h.T, fit.h @ x.T, lasso, ridge).T
    told = 0.5 * ((x - w @ fit.h) ** 2).sum() + lasso * (np.abs(w).sum() + np.abs(fit.h).sum()) + 0.5 * ridge * ((w**2).sum() + (fit.h**2).sum())
    assert 0.8 * fit.losses[-1] < told <= fit.losses[-1] + 1e-9
    assert (factors.elastic_net(vectors(spark, np.abs(x)), "v", 2, 0.2, 0.5, rounds=5, positive=True).h >= 0).all()
    assert factors.elastic_net(vectors(spark, x).limit(0), "v", 2).losses == []


def test_sparse_components(spark):
    rng = np.random.default_rng(7)
    true = np.zeros((2, 10))
    true[0, :4], true[1, 5:8] = 0.5, 0.577
    x = rng.normal(size=(500, 2)) * [3, 2] @ true + 0.1 * rng.normal(size=(500, 10))
    df = vectors(spark, x)
    fit = factors.sparse_principal(df, "v", 2, 0.8)
    assert all(b <= a + 1e-9 for a, b in zip(fit.losses, fit.losses[1:], strict=False))
    assert [(np.abs(h) > 0).nonzero()[0].tolist() for h in fit.h] == [[0, 1, 2, 3], [5, 6, 7]]
    c = np.cov(x.T, bias=True)
    a = np.linalg.eigh(c)[1][:, ::-1][:, :2]
    want = None
    for _ in range(len(fit.losses)):  # the same rounds by plain gradient steps
        b = np.zeros_like(a) if want is None else want
        step = 1 / (np.linalg.eigvalsh(c)[-1] + 0.01)
        for _ in range(4000):
            g = b - step * (c @ (b - a) + 0.01 * b)
            b = np.sign(g) * np.maximum(np.abs(g) - step * 0.4, 0)
        want = b
        u, _, v = np.linalg.svd(c @ b, full_matrices=False)
        a = u @ v
    assert np.allclose(np.abs(fit.h), np.abs(factors.unit_rows(want)), atol=1e-4)
    batched = factors.sparse_principal_batches(df, "v", 2, "pos", 10, 0.8)
    assert np.allclose(np.abs(batched.h), np.abs(fit.h), atol=0.05) and len(batched.losses) == 10
    assert factors.sparse_principal(df.limit(0), "v", 2).h.size == 0 and factors.sparse_principal_batches(df.limit(0), "v", 2, "pos").h.size == 0


def test_errors(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    df = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, y, strict=True)] + [(None, [1.0])], "a array<double>, b array<double>")
    r = factors.errors(df, "a", "b").collect()[0]
    res, p, q = ((x - y) ** 2).sum(), np.maximum(x, 1e-10), np.maximum(y, 1e-10)
    want = [np.linalg.norm(x), np.linalg.norm(y), np.sqrt(res), np.sqrt(res) / np.linalg.norm(x), res, ((x - x.mean()) ** 2).sum(), 1 - res / ((x - x.mean()) ** 2).sum(), (p * np.log(p / q) - p + q).sum()]
    assert list(r) == pytest.approx(want)


def gauss(x, sigma):
    """Along the last axis, the border reflected."""
    if not sigma:
        return x
    h = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-h, h + 1) / sigma) ** 2)
    padded = np.pad(x, ((0, 0), (h, h)), mode="symmetric")
    return np.stack([np.convolve(row, w / w.sum(), "valid") for row in padded])


def normal(x):
    s = x.std(axis=1, keepdims=True)
    return (x - x.mean(axis=1, keepdims=True)) / np.where(s > 0, s, 1)


def predicted(test, h, mu):
    out = np.zeros_like(test)
    for i in range(len(test)):
        rest = np.delete(np.arange(len(test)), i)
        out[i] = h[:, i] @ np.linalg.lstsq(h[:, rest].T, test[rest] - mu[rest, None], rcond=None)[0] + mu[i]
    return out


def test_cross_validated_components(spark):
    rng = np.random.default_rng(9)
    n, d = 83, 6
    x = rng.normal(size=(d, 2)) @ gauss(rng.normal(size=(2, n)), 2.0) + 0.1 * rng.normal(size=(d, n))
    df = spark.createDataFrame([(c, k, float(x[c, k])) for c in range(d) for k in range(n)], "cell int, pos bigint, value double")
    found = factors.cross_validated(df, "cell", "pos", "value", list(range(d)), n, [0.0, 1.0], [1, 3], folds=4)
    assert len(found) == 2 * 2 * 4
    size = -(-n // 4)
    for r in found:
        a, b = r["fold"] * size, min(n, (r["fold"] + 1) * size)
        train, test = np.delete(x, np.arange(a, b), axis=1), x[:, a:b]
        tr, te, ts = normal(gauss(train, r["sigma"])), normal(test), normal(gauss(test, r["sigma"]))
        mu = tr.mean(axis=1)
        h = np.linalg.svd((tr - mu[:, None]).T, full_matrices=False)[2][: r["k"]]
        rec = h.T @ h @ (tr - mu[:, None]) + mu[:, None]
        assert r["train_err_sm"] == pytest.approx(np.linalg.norm(tr - rec) / d, rel=1e-6)
        assert r["test_err"] == pytest.approx(np.linalg.norm(te - predicted(te, h, mu)) / d, rel=1e-6)
        assert r["test_err_sm"] == pytest.approx(np.linalg.norm(ts - predicted(ts, h, mu)) / d, rel=1e-6)
        assert (r["test_norm"], r["test_norm_sm"]) == pytest.approx((np.linalg.norm(te) / d, np.linalg.norm(ts) / d))


def test_cross_validated_factors_and_shuffles(spark):
    rng = np.random.default_rng(10)
    n, d = 60, 5
    x = rng.gamma(1.0, size=(d, 1)) @ rng.gamma(1.0, size=(1, n)) + 0.05 * rng.normal(size=(d, n))
    df = spark.createDataFrame([(c, k, float(x[c, k])) for c in range(d) for k in range(n)], "cell int, pos bigint, value double")
    found = factors.cross_validated(df, "cell", "pos", "value", list(range(d)), n, [0.0], [1], folds=3, method="nmf", reps=2, shuffle=True, rounds=8)
    assert len(found) == 3 * 2 * 2
    mean = {s: np.mean([r["test_err"] for r in found if r["shuffled"] == s]) for s in (False, True)}
    assert mean[False] < 0.6 * mean[True]
    assert all(np.isfinite(list(r.values())).all() for r in found)


def test_left_out_matrix():
    rng = np.random.default_rng(11)
    h, x = rng.normal(size=(2, 7)), rng.normal(size=(7, 20))
    assert np.allclose((x.T @ factors.left_out_matrix(h)).T, predicted(x, h, np.zeros(7)))


def test_moments_far_from_zero(spark):
    """At a mean of 1e8 and a deviation of 0.1 variances and components keep their digits, also with an outlier among the first rows."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 3)) @ np.diag([0.1, 0.2, 0.3]) + 1e8
    df = vectors(spark, x)
    c = np.cov((x - 1e8).T, bias=True)
    assert np.allclose(linalg.moments(df, "v")[None].scatter / 4000, c, rtol=1e-6, atol=1e-9)
    assert np.allclose(linalg.principal(df, "v").variances, np.linalg.eigvalsh(c * 4000 / 3999)[::-1], rtol=1e-6)
    out = df.unionByName(vectors(spark, [[-1e8, 0, 1e8]]))
    y = np.vstack([x, [-1e8, 0, 1e8]])
    assert np.allclose(linalg.moments(out, "v")[None].scatter, (y - y.mean(0)).T @ (y - y.mean(0)), rtol=1e-9)
    parts = linalg.moments(df.withColumn("g", F.col("pos") % 3), "v", "g")
    whole = parts[0] + parts[1] + parts[2]
    assert np.allclose(whole.mean, x.mean(0), rtol=1e-14) and np.allclose((whole - parts[1]).scatter, parts[0].scatter + parts[2].scatter, rtol=1e-2)
    assert np.allclose(whole.raw[:-1, -1], x.sum(0), rtol=1e-12) and np.allclose(whole.part([2, 0]).scatter, whole.scatter[np.ix_([2, 0], [2, 0])])
