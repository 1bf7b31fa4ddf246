"""Operators against NumPy: edges of series, borders of chunks, linear models, pictures, readers."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.functions import columns
from tracegrid.operators import asof, decoding, linalg, ordered, raster, series, stats
from tracegrid.operators.ordered import carried, positions, running
from tracegrid.sources import sessions


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(2)
    rows = [(s, k, float(x)) for s, n in (("a", 40), (None, 11)) for k, x in enumerate(rng.normal(size=n))]
    return spark.createDataFrame(rows, "s string, k bigint, x double").repartition(3)


def series_of(df, column):
    out = {}
    for r in df.orderBy("k").collect():
        out.setdefault(r["s"], []).append(r[column])
    return out


@pytest.mark.parametrize("edge,pad", [("zero", "constant"), ("nearest", "edge"), ("reflect", "symmetric")])
def test_filter_edges_across_chunks(wave, edge, pad):
    w = series.taps("even", 1.2)
    got = series_of(series.filtered(wave, ["s"], "k", {"y": "x"}, w, edge, chunk=7), "y")
    for s, x in series_of(wave, "x").items():
        assert np.allclose(got[s], np.convolve(np.pad(x, len(w) // 2, mode=pad), w, "valid"))


@pytest.mark.parametrize("edge,pad", [("zero", "constant"), ("nearest", "edge"), ("reflect", "symmetric")])
def test_long_kernels_slide_over_chunks(wave, edge, pad):
    """No list of rows is put together for each row; half-widths may exceed a series' length."""
    w, h = series.taps("even", 4.0), 16
    made = series.filtered(wave, ["s"], "k", {"x": "x", "y": "x"}, w, edge, chunk=16)
    assert made.columns == ["s", "k", "x", "y"] and "collect_list" not in made._jdf.queryExecution().toString()
    for s, x in series_of(wave, "x").items():
        want = np.convolve(np.pad(x, h, mode=pad), w, "valid")
        known = [edge != "reflect" or max(h - k, h - (len(x) - 1 - k)) <= len(x) for k in range(len(x))]
        for column in "xy":
            got = series_of(made, column)[s]
            assert [v is not None for v in got] == known and np.allclose([v for v in got if v is not None], want[known])


def test_detrended_all_reads_once_for_each_sigma(wave):
    rows = wave.withColumns({"v": F.when(F.col("k") % 7 != 3, F.col("x")), "few": F.when(F.col("k") < 2, F.col("x"))})
    made = series.detrended_all(rows, ["s"], "k", {"a": ("x", 1.0), "b": ("x", 2.0), "c": ("v", 2.0), "d": ("few", 2.0)}, chunk=9)
    assert made.columns == ["s", "k", "x", "v", "few", "a", "b", "c", "d"]
    assert made._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 2
    for s, x in series_of(rows, "x").items():
        k = np.arange(len(x))
        for out, keep, sigma in (("a", k >= 0, 1.0), ("b", k >= 0, 2.0), ("c", k % 7 != 3, 2.0)):
            w = series.taps("even", sigma)
            run = lambda v, w=w: np.convolve(np.pad(v, len(w) // 2, mode="edge"), w, "valid")
            got = series_of(made, out)[s]
            assert [v is not None for v in got] == keep.tolist()
            assert np.allclose([v for v in got if v is not None], (x - run(np.where(keep, x, 0.0)) / run(keep.astype(float)))[keep])
        assert series_of(made, "d")[s] == series_of(rows, "few")[s]


def test_gradient_unwrap_and_runs_across_chunks(wave, spark):
    timed = wave.withColumn("t", F.col("k") + F.col("k") * F.col("k") / 50)
    got = series_of(series.gradient(timed, ["s"], "k", "x", "g", "t", chunk=5), "g")
    turned = series_of(series.unwrapped(wave.withColumn("x", F.col("x") * 4), ["s"], "k", "x", "u", chunk=5), "u")
    summed = series_of(running(wave, ["s"], "k", {"c": F.col("x")}, chunk=5), "c")
    for s, x in series_of(wave, "x").items():
        k = np.arange(len(x))
        assert np.allclose(got[s], np.gradient(x, k + k * k / 50)) and np.allclose(turned[s], np.unwrap(np.array(x) * 4)) and np.allclose(summed[s], np.cumsum(x))
    rows = wave.withColumn("b", F.col("x") > 0)
    lengths = {s: [r["length"] for r in series.runs(rows, ["s"], "k", "b", chunk=5).where(F.col("s").eqNullSafe(F.lit(s))).orderBy("run").collect()] for s in ("a", None)}
    for s, x in series_of(wave, "x").items():
        assert lengths[s] == [len(list(g)) for _, g in itertools.groupby(v > 0 for v in x)]


def test_more_rows_are_more_parts(wave, monkeypatch):
    """A task orders no more than PART rows or so; buckets without a value, NULL times and NULL keys keep what is carried."""
    rows = wave.withColumns({"v": F.when(F.col("k").isin(3, 30), F.col("x")), "w": F.when(F.col("k") % 9 == 1, F.col("x")), "t": F.when(F.col("k") != 5, F.col("k").cast("double"))})
    wanted = {"a": ("v", [F.col("x")], False), "b": ("w", [F.col("x")], True)}
    monkeypatch.setattr(ordered, "PART", 2)
    made = ordered.carried_all(rows, ["s"], "t", wanted, 4.0)
    assert made.rdd.getNumPartitions() == 26  # of 51 rows
    assert made.columns == [*rows.columns, "a", "b"]
    a, b = (sorted(map(str, d.select("s", "k", "a", "b").collect())) for d in (made, ordered.carried_all(rows, ["s"], "t", wanted)))
    assert a == b and len(a) == 51


def test_buckets_of_time_change_nothing(wave):
    rows = wave.withColumn("v", F.when(F.col("k") % 7 == 3, F.col("x")))
    for forward in (False, True):
        a, b = (sorted(map(str, carried(rows, ["s"], "k", [F.col("x")], "v", "o", forward=forward, width=w).select("s", "k", "o").collect())) for w in (None, 4.0))
        assert a == b
    a, b = (sorted(map(str, positions(wave, ["s"], "x", ["k"], "p", width=w).select("s", "k", "p").collect())) for w in (None, 0.3))
    assert a == b


def test_interpolation_against_numpy(spark):
    samples = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 7.0), (1, 4.0, 1.0), (1, float("nan"), 9.0)], "s int, t double, v double")
    spine = spark.createDataFrame([(1, x) for x in (0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0)] + [(2, 1.0), (1, None)], "s int, g double")
    got = {r["g"]: r["v"] for r in asof.interpolated(spine, samples, ["s"], "g", "t", ["v"]).where("s = 1").collect()}
    for g, v in got.items():
        assert v is None if g is None else math.isclose(v, np.interp(g, [1, 2, 4], [5, 7, 1]))
    zero = {r["g"]: r["v"] for r in asof.interpolated(spine, samples, ["s"], "g", "t", ["v"], "nearest", "zero").where("s = 1").collect()}
    assert zero[0.0] == zero[9.0] == 0 and zero[1.5] == 5 and zero[3.0] == 7
    assert asof.interpolated(spine, samples, ["s"], "g", "t", ["v"]).where("s = 2 and v is null").count() == 1


def test_quantiles_with_ties_and_hot_groups(spark):
    rng = np.random.default_rng(0)
    values = {1: [5.0] * 900 + rng.normal(size=100).tolist(), 2: [1.0], 3: rng.normal(size=777).tolist()}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [(1, None)], "g int, v double")
    for r in stats.quantiles(df, ["g"], "v", [0.0, 0.033, 0.5, 0.9, 1.0], cuts=16).collect():
        assert math.isclose(r["q"], np.percentile(values[r["g"]], 100 * r["p"]), abs_tol=1e-12)


def test_linear_models_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(103, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=103)
    df = spark.createDataFrame([(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "pos bigint, v array<double>, y double").repartition(3)
    found = linalg.principal(df, "v")
    assert np.allclose(found.variances, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    got = {r["pos"]: r["pred_y"] for r in decoding.ridge_oof(df, "v", ["y"], "pos", 103, 5, 3, 2.0).collect()}
    edges = decoding.fold_edges(103)
    for lo, hi in zip(edges, edges[1:], strict=False):
        train = np.array([k for k in range(103) if k < lo - 3 or k >= hi + 3])
        m, s = x[train].mean(0), x[train].std(0)
        z = (x[train] - m) / s
        w = np.linalg.solve(z.T @ z + 2 * np.eye(4), z.T @ (y[train] - y[train].mean()))
        assert np.allclose([got[k] for k in range(lo, hi)], (x[lo:hi] - m) / s @ w + y[train].mean())
    beta = decoding.logistic(df.withColumn("y", (F.col("y") > 0).cast("double")), "v", "y", 0.7)
    p = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
    assert np.allclose(x.T @ (p - (y > 0)) + beta[:-1] / 0.7, 0, atol=1e-6) and abs((p - (y > 0)).sum()) < 1e-6
    _, errors = linalg.factorised(df.withColumn("v", F.transform("v", F.abs)), "v", 2, 6)
    assert errors[-1] <= errors[0]


def test_assignment_against_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 6):
        gain = rng.normal(size=(n, n))
        best = max(sum(gain[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n)))
        assert math.isclose(sum(gain[i, j] for i, j in enumerate(linalg.assigned(gain))), best)


def test_flow_against_numpy(spark):
    rng = np.random.default_rng(7)
    movie = rng.normal(size=(3, 8, 9))
    rows = [(t, y, x, float(v)) for (t, y, x), v in np.ndenumerate(movie)]
    got = {(r["f"], r["iy"], r["ix"]): (r["u"], r["v"], r["div"]) for r in raster.flow(spark.createDataFrame(rows, "f int, row int, col int, value double"), [], "f", 8, 9, (2, 3)).collect()}
    ys, xs = columns.bounds(8, 2), columns.bounds(9, 3)
    for t in (1, 2):
        gx, gy, d = np.gradient(movie[t], axis=1), np.gradient(movie[t], axis=0), movie[t] - movie[t - 1]
        cell = lambda a: np.add.reduceat(np.add.reduceat(a, ys[:-1], axis=0), xs[:-1], axis=1)
        u, v = np.zeros((2, 3)), np.zeros((2, 3))
        for i, j in np.ndindex(2, 3):
            a = np.array([[cell(gx * gx)[i, j], cell(gx * gy)[i, j]], [cell(gx * gy)[i, j], cell(gy * gy)[i, j]]]) + 1e-3 * np.eye(2)
            u[i, j], v[i, j] = -np.linalg.solve(a, [cell(gx * d)[i, j], cell(gy * d)[i, j]])
        div = np.gradient(u, axis=1) + np.gradient(v, axis=0)
        for i, j in np.ndindex(2, 3):
            assert np.allclose(got[(t, i, j)], (u[i, j], v[i, j], div[i, j]))
    assert got[(0, 0, 0)] == (0.0, 0.0, 0.0)


def test_sessions_from_files(spark, tmp_path):
    (tmp_path / "m1s_2024_1_2_3h_4m_Events.csv").write_text("Time,event\n1.5,Lick\n2.0,Reward\n")
    (tmp_path / "m1s_2024_1_2_3h_4m_params.json").write_text(json.dumps({"objectRewardZoneDistance": 144.0, "rewardZonesOn": 1}))
    rows = sessions.table(spark, str(tmp_path), "Events").orderBy("row").collect()
    assert [(r["session"], r["row"], r["event"]) for r in rows] == [("m1s_2024_1_2_3h_4m", 0, "Lick"), ("m1s_2024_1_2_3h_4m", 1, "Reward")]
    p = sessions.parameters(spark, str(tmp_path)).first()
    assert (p["zone"], p["zonal"], p["lick_reward"]) == (12.0, 1.0, 0.0)
    assert sessions.files(spark, str(tmp_path), [".csv", ".json"], ["2024", "params"]).count() == 1


@pytest.mark.parametrize("made", [lambda df: stats.quantiles(df, ["g"], "v", [0.25, 0.75]), lambda df: stats.average_ranks(df, ["g"], "v", "r")])
def test_cuts_are_taken_once(spark, made):
    """Approximate cuts follow the order in which parts arrive, so a plan that takes them twice may deal a value to two buckets."""
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    assert "percentile_approx" not in made(df)._jdf.queryExecution().optimizedPlan().toString()
