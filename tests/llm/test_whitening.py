"""Whitening against NumPy and whole-number arithmetic, and its defined results in odd cases."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], "vec_id bigint, embedding array<double>")


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(3 * d, d)) * np.logspace(0, -4, d)
    values, vectors = whitening.jacobi(a.T @ a)
    assert np.allclose(np.sort(values), np.linalg.eigvalsh(a.T @ a), rtol=1e-8, atol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    assert np.allclose(vectors * values @ vectors.T, a.T @ a, atol=1e-13)


def test_small_eigenvalues_are_accurate():
    """A graded matrix: rotations keep the relative accuracy of eigenvalues of 1e-24."""
    scale = np.diag([1.0, 1e-6, 1e-12])
    a = scale @ np.array([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]]) @ scale
    values = np.sort(whitening.jacobi(a)[0])[::-1]
    # the product of the eigenvalues is the determinant, and the smallest is close to its Schur complement
    assert np.isclose(values.prod(), np.linalg.det(np.array([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]])) * 1e-36, rtol=1e-10)


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) * 0.2
    v[100:200] = v[3]
    rows = [(k, v[k]) for k in range(300)] + [(300, None), (301, [None] * 20), (302, [float("nan")] * 20), (303, [float("-inf")] * 20)]
    found = whitening.whiten(frame(spark, rows).withColumns({"x": F.lit(1), "n": F.lit("a"), "key": F.lit(None).cast("string")})).toPandas()
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert len(found) == 300 * 16 and set(found["n"]) == {n}
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-10
    made = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (n * x - s) / n @ vectors / np.sqrt(values)
    signs = np.sign((made * want).sum(axis=0))
    assert np.allclose(made, want * signs, atol=1e-8)
    assert np.allclose(found.groupby("component")["explained"].first(), values / np.trace(y.T @ y / n), rtol=1e-9)
    assert (found.groupby("vec_id")["deviation"].first().to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all()


def test_odd_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] == 0 for r in one)
    # lengths are fitted apart, and a direction without variance has no whitened value
    rows = [(1, [1.0, 2.0, 2.0]), (2, [2.0, 1.0, 1.0]), (3, [5.0, 5.0, 5.0]), (4, [7.0]), (5, [9.0])]
    found = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame(spark, rows)).collect()}
    assert len(found) == 3 * 3 + 2
    assert found[1, 3]["whitened"] is None and found[1, 2]["whitened"] is not None and found[1, 1]["n"] == 3
    assert [abs(found[k, 1]["whitened"]) for k in (4, 5)] == [1.0, 1.0] and found[4, 1]["explained"] == 1.0 and found[4, 1]["n"] == 2


def test_huge_entries(spark):
    big = (1 << 40) / 64
    rows = [(1, [1e300, 0.0]), (2, [big, 1.0]), (3, [-1e300, 2.0])]
    found = {r["vec_id"]: r for r in whitening.whiten(frame(spark, rows)).where("component = 1").collect()}
    x = np.array([[1 << 40, 0], [1 << 40, 64], [-(1 << 40), 128]], dtype=object)
    s = x.sum(axis=0)
    exact = [int(((3 * row - s) ** 2).sum()) for row in x]
    assert [found[k]["deviation"] for k in (1, 2, 3)] == [e if e < 1 << 63 else None for e in exact]
    assert all(np.isfinite(found[k]["whitened"]) for k in (1, 2, 3))
    assert Fraction(found[1]["n"]) == 3
