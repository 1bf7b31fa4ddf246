"""Composites against NumPy: motion of what is in view, blocks on another clock, tuning, thresholds, movies and small rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import drivers, movies

T = 60


def gauss(x, sigma):
    h = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-h, h + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, h, mode="edge"), w / w.sum(), "valid")


@pytest.fixture(scope="module")
def side():
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.uniform(0.05, 0.15, T))
    there = rng.random(T) < 0.8
    lat, vert, dist = (np.where(there, x, 0.0) for x in (np.sin(t), np.cos(2 * t) / 2, 5 + np.sin(t / 2)))
    return t, there, lat, vert, dist, np.arange(T) // 17


def side_frame(spark, side):
    t, there, lat, vert, dist, obj = side
    return spark.createDataFrame([(k, float(t[k]), float(there[k]), float(lat[k]), float(vert[k]), float(dist[k]), int(obj[k])) for k in range(T)], "pos bigint, t double, presence double, lat double, vert double, dist double, obj int")


def test_motion_features(spark, side):
    t, there, lat, vert, dist, obj = side
    s = [gauss(x, 2.0) for x in (lat, vert, dist)]
    d = [np.gradient(x, t) for x in s]
    ang = np.gradient(2 * np.arctan2(1.5, np.maximum(s[2], 1e-6)), t)
    turn = np.arctan2(d[1], d[0])
    want = np.stack([*d, ang, np.hypot(d[0], d[1]), np.sin(turn), np.cos(turn)], axis=1) * there[:, None]
    rows = sorted(drivers.motion_features(side_frame(spark, side), [], "pos", "t", 1.5, 2.0).collect())
    assert np.allclose([r[2:] for r in rows], want, atol=1e-9)
    near = sorted(drivers.motion_features(side_frame(spark, side), [], "pos", "t", 1.5, 2.0, "obj").collect(), key=lambda r: r["pos"])
    swap = np.array([k for k in range(1, T) if obj[k] != obj[k - 1] and there[k] and there[k - 1]])
    masked = np.array([len(swap) > 0 and np.abs(swap - k).min() <= 5 for k in range(T)])
    assert [r["d_lat"] is None for r in near] == masked.tolist() and masked.any()
    assert drivers.motion_features(side_frame(spark, side).limit(0), [], "pos", "t").count() == 0


def view_rows():
    """(pos, obj_id, lat, vert, dist) of one side; frames 10 to 19 show nothing."""
    rng = np.random.default_rng(2)
    return [(k, o, float(rng.normal(0, 0.3)), float(rng.normal(0, 0.2)), float(rng.uniform(1, 9))) for k in range(T) if not 10 <= k < 20 for o in range(int(rng.integers(1, 4)))]


def test_feature_blocks(spark):
    t = np.arange(T) * 0.1
    at = np.array([0.02, 0.55, 1.23, 1.51, 3.3, 5.87, 7.0])
    rng = np.random.default_rng(3)
    lick = (rng.random(T) < 0.2).astype(float)
    x = rng.normal(size=(T, 2)).cumsum(axis=0)
    beh = spark.createDataFrame([(k, float(t[k]), float(x[k, 0]), 0.0, float(x[k, 1]), 0.1 * k, float(lick[k])) for k in range(T)], "pos bigint, t double, x double, y double, z double, heading double, lick double")
    frames = spark.createDataFrame([(float(a),) for a in at], "at double")
    view = spark.createDataFrame(view_rows(), "pos bigint, obj_id int, lat double, vert double, dist double")
    pics = spark.createDataFrame([(k, [float(v) for v in rng.normal(size=9)]) for k in range(T)], "pos bigint, v array<double>")
    blocks = drivers.feature_blocks({"L": view, "R": view.where("obj_id = 0")}, beh, frames, [], "pos", "t", "at", 1.5, 10.0, pictures=pics, n_pix=3, pix_slopes=1.0, motion=1.0, objects=[0, 2], self_moving=1.0, counts=["lick"])
    assert set(blocks) == {"agg", "pix", "pix_mot", "motion", "per_obj", "self_mot", "beh"}
    agg = {round(r["at"], 3): r for r in blocks["agg"].collect()}
    assert len(agg) == len(at)
    by = {}
    for k, o, lat, vert, dist in view_rows():
        by.setdefault(k, []).append((o, lat, vert, dist))
    w = lambda d: 2 * math.atan2(1.5, d)
    mean = lambda k, i: sum(w(o[3]) * o[i] for o in by[k]) / sum(w(o[3]) for o in by[k]) if k in by else 0.0
    for a in at:
        r, k = agg[round(a, 3)], min(T - 1, int(math.floor(a / 0.1 + 1e-9)))
        nearest = min(range(T), key=lambda j: (abs(t[j] - a), j))
        assert r["presence_L"] == float(nearest in by)
        if nearest in by:
            part = (a - t[k]) / 0.1 if k + 1 < T else 0.0
            assert r["lat_L"] == pytest.approx(mean(k, 1) * (1 - part) + mean(min(k + 1, T - 1), 1) * part, abs=1e-9)
        else:
            assert r["lat_L"] is None and r["ang_size_L"] is None
    assert agg[1.23]["presence_L"] == 0 and "presence_R" in blocks["agg"].columns
    motion = {round(r["at"], 3): r for r in blocks["motion"].collect()}
    assert motion[1.23]["d_lat_L"] is None and motion[3.3]["d_ang_size_R"] is not None
    per = {round(r["at"], 3): r for r in blocks["per_obj"].collect()}
    assert {c for c in blocks["per_obj"].columns if c.endswith("_L")} == {f"o{o}_{v}_L" for o in (0, 2) for v in ("presence", "lat", "vert", "ang_size")}
    nearest = min(range(T), key=lambda j: (abs(t[j] - 3.3), j))
    assert per[3.3]["o2_presence_L"] == float(any(o[0] == 2 for o in by[nearest]))
    beh_rows = {round(r["at"], 3): r["lick"] for r in blocks["beh"].collect()}
    assert beh_rows[0.55] == lick[min(range(T), key=lambda j: (abs(t[j] - 0.55), j))]
    assert all(len(r["v"]) == 3 for r in blocks["pix"].collect()) and blocks["pix_mot"].count() == len(at) and blocks["self_mot"].count() == len(at)


def textured(dr, dc, height=32, width=40):
    rng = np.random.default_rng(4)
    r, c = np.mgrid[:height, :width]
    return sum(np.cos(a * (r - dr) + b * (c - dc) + p) for a, b, p in zip(rng.normal(0, 0.35, 10), rng.normal(0, 0.35, 10), rng.uniform(0, 6, 10), strict=True))


def movie(spark, moves):
    rows = [(k, i, j, float(p[i, j])) for k, move in enumerate(moves) for p in [textured(*move)] for i in range(32) for j in range(40)]
    return spark.createDataFrame(rows, "frame int, row int, col int, value double")


@pytest.mark.parametrize("move", [(1.3, -0.7), (2.6, 1.9), (0.0, 0.0)])
def test_planted_motion_is_recovered(move):
    d = movies.displacement(textured(0, 0)[None], textured(*move)[None])[0][6:-6, 6:-6]
    assert np.abs(d - np.array(move)).max() < 0.2


def test_dense_flow(spark):
    rows = movies.dense_flow(movie(spark, [(0, 0), (0.6, -1.2), (0.6, -1.2)]), [], "frame", 32, 40, (2, 2)).collect()
    assert len(rows) == 12
    for r in rows:
        u, v = {0: (0, 0), 1: (-1.2, 0.6), 2: (0, 0)}[r["frame"]]
        assert (r["u"], r["v"]) == pytest.approx((u, v), abs=0.25)
        if r["frame"] == 0:
            assert (r["speed"], r["dirsin"], r["dircos"], r["div"]) == (0, 0, 0, 0)
    assert movies.dense_flow(movie(spark, [(0, 0)]).limit(0), [], "frame", 32, 40, (2, 2)).count() == 0


def test_smoothed_movie(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(6, 7, 8))
    m[2, 3, 4] = np.nan
    rows = spark.createDataFrame([(k, i, j, None if np.isnan(m[k, i, j]) else float(m[k, i, j])) for k in range(6) for i in range(7) for j in range(8)], "frame int, row int, col int, value double")
    found = {(r["frame"], r["row"], r["col"]): r["s"] for r in movies.smoothed_movie(rows, [], "frame", "value", "s", (1.0, 0.0, 0.7)).collect()}
    has, x = ~np.isnan(m), np.nan_to_num(m)
    g = lambda n, s: np.exp(-0.5 * ((np.arange(n)[:, None] - np.arange(n)) / s) ** 2) * (np.abs(np.arange(n)[:, None] - np.arange(n)) <= int(4 * s + 0.5))
    a, b = g(6, 1.0), g(8, 0.7)
    want = np.einsum("kl,lij,jm->kim", a, x, b) / np.einsum("kl,lij,jm->kim", a, has.astype(float), b)
    assert all(v == pytest.approx(want[k]) for k, v in found.items())


def test_visual_blocks(spark):
    left = movie(spark, [(0.1 * k, 0.0) for k in range(6)]).where("row < 16 and col < 20")
    times = spark.createDataFrame([(k, 0.5 * k) for k in range(6)], "frame int, t double")
    frames = spark.createDataFrame([(0.0,), (0.6,), (9.0,)], "at double")
    specs = {"grid": {"grid": (2, 2)}, "motion": {"kind": "flow", "grid": (2, 3), "method": "farneback", "n_pca": 4}, "pixels": {"n_pca": 2}}
    found = movies.visual_blocks({"L": left, "R": left}, times, frames, [], "frame", "t", "at", 16, 20, specs)
    sizes = {name: {len(r["v"]) for r in df.collect()} for name, df in found.items()}
    assert sizes == {"grid": {2 * 4 * 3}, "motion": {4}, "pixels": {2}}
    from tracegrid.operators.raster import cell_statistics

    cells = {(r["frame"], r["iy"], r["ix"]): r for r in cell_statistics(left, ["frame"], 16, 20, (2, 2)).collect()}
    row = {r["at"]: r["v"] for r in found["grid"].collect()}
    want = lambda k: [cells[k, i, j][v] for v in ("occ", "mean", "edge") for i in (0, 1) for j in (0, 1)]
    assert row[0.0][:12] == pytest.approx(want(0)) and row[0.6][:12] == pytest.approx([0.8 * a + 0.2 * b for a, b in zip(want(1), want(2), strict=True)]) and row[9.0][12:] == pytest.approx(want(5))
    with pytest.raises(KeyError):
        movies.visual_blocks({"L": left}, times, frames, [], "frame", "t", "at", 32, 40, {"x": {}})


def test_pictures_stacked_and_rebuilt(spark):
    from tracegrid.operators import linalg

    rng = np.random.default_rng(6)
    v = rng.uniform(0, 255, size=(5, 1)) * np.ones((1, 6)) + rng.normal(size=(5, 6))
    df = spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(5)], "frame bigint, v array<double>")
    found = linalg.principal(df, "v")
    made = movies.rebuilt_movie(linalg.scores(df, "v", found, ["frame"]), "scores", found, ["frame"], 6, 3)
    got = {(r["frame"], r["row"], r["col"]): r["value"] for r in made.collect()}
    assert len(got) == 30 and all(abs(got[k, i, j] - np.floor(np.clip(v[k, 3 * i + j], 0, 255))) <= 1 for k, i, j in got)
    scaled = movies.to_bytes(made.withColumn("value", F.col("value").cast("double")), [], "scale").agg(F.min("value"), F.max("value")).collect()[0]
    assert tuple(scaled) == (0, 255)
    both = movies.stacked(made, made.where("frame < 3"), ["frame"], 2, 1).collect()
    assert len(both) == 3 * 12 and {r["row"] for r in both} == {0, 1, 3, 4}


def test_packed_pictures(spark):
    px = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 0, 2.0), (0, 1, 1, None), (0, 9, 0, 5.0), (1, 1, 2, 3.0), (2, 0, 0, None)], "frame int, row int, col int, value double")
    assert {r["frame"]: r["pixels"] for r in movies.packed(px, [], "frame", 2, 3).collect()} == {0: [2.0, 0, 0, 0, 0, 0], 1: [0, 0, 0, 0, 0, 3.0], 2: [0.0] * 6}


def test_tuned_cells(spark):
    rng = np.random.default_rng(7)
    rows = []
    for cell in range(3):
        for trial in range(60):
            kind = trial % 3
            x = rng.normal(size=12) * 0.3
            if cell == 0 and kind == 1:
                x[5:8] += 3
            if cell == 1 and kind == 2:
                x[0:2] += 3  # too early
            rows += [(cell, kind, trial, k, float(x[k])) for k in range(12)]
    df = spark.createDataFrame(rows, "cell int, kind int, trial int, rel int, value double")
    found = {(r["cell"], r["kind"]): r for r in drivers.tuned(df, "cell", "kind", "trial", "rel", "value", [0, 1, 2], (3, 11), 200).collect()}
    assert len(found) == 9 and [k for k, r in found.items() if r["tuned"]] == [(0, 1)]
    assert 5 <= found[0, 1]["at"] <= 7 and found[1, 2]["peak"] > found[1, 2]["threshold"] and found[1, 2]["at"] < 3
    assert {r["threshold"] for r in found.values() if r["cell"] == 0} == {found[0, 0]["threshold"]}


@pytest.mark.parametrize("method", ["nmf", "pca"])
def test_shuffled_thresholds(spark, method):
    rng = np.random.default_rng(8)
    x = rng.gamma(1.0, size=(4, 50))
    df = spark.createDataFrame([(c, k, float(x[c, k])) for c in range(4) for k in range(50)], "cell int, pos bigint, value double")
    found = {r["of"]: (r["low"], r["high"]) for r in drivers.shuffled_thresholds(df, "cell", "pos", "value", [0, 1, 2, 3], 50, 2, 6, 90.0, method, 5).collect()}
    assert set(found) == {"loadings", "scores"}
    for low, high in found.values():
        assert (low is None and high > 0) if method == "nmf" else low < 0 < high
    if method == "pca":  # each place keeps its variance, so that scores' spread is known
        assert found["scores"][1] < 6


def test_trial_components(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 4)) * [3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(80)], "pos bigint, v array<double>")
    anchors = spark.createDataFrame([(10,), (30,), (79,)], "pos bigint")
    found, scored = drivers.trial_components(df, anchors, [], "pos", "v", 2, 4, 2)
    own = np.concatenate([x[8:14], x[28:34], x[77:80]])
    c = own - own.mean(0)
    assert np.allclose(found.variances, np.linalg.svd(c, compute_uv=False) ** 2 / (len(own) - 1))
    rows = {(r["anchor"], r["rel"]): r["scores"] for r in scored.collect()}
    assert len(rows) == 15 and np.allclose(rows[30, -2], found.loadings @ (x[28] - own.mean(0)))


def test_small_rows(spark):
    assert drivers.window_frames((-0.05, 0.95), 30) == ([2, 29], [round(k / 30, 4) for k in range(-2, 29)])
    rng = np.random.default_rng(10)
    turns, where = rng.normal(size=(5, 3)), np.array(drivers.sensor_directions())
    df = spark.createDataFrame([(k, *map(float, where @ turns[k])) for k in range(5)], "k int, a double, b double, c double, d double")
    back = sorted(drivers.from_projections(df, ["a", "b", "c", "d"], where.tolist()).collect())
    assert np.allclose([[r["ax"], r["ay"], r["az"]] for r in back], turns)
    objects = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0), (2, 0, 0.0, 0.0, -5.0)], "obj_id int, kind int, x double, y double, z double")
    shapes = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 1.0, 0.0)], "kind int, vertex int, x double, y double, z double")
    seen = {(r["obj_id"], r["vertex"]): (r["u"], r["v"]) for r in drivers.vertices_in_view(objects, shapes, 0.0, math.pi / 2, 1.5).collect()}
    assert set(seen) == {(1, 0), (1, 1)} and seen[1, 1] == pytest.approx((0.2, math.tan(math.acos(1 / math.sqrt(27)) - math.pi / 2)))
    text = spark.createDataFrame([(1, "[[0, 0], [2, 4]]"), (2, "none"), (3, None)], "k int, text string")
    assert sorted(tuple(r) for r in drivers.corners(text, ["k"], "text").collect()) == [(1, 0, 0.0, 0.0, 1.0, 2.0), (1, 1, 2.0, 4.0, 1.0, 2.0)]
    assert [tuple(r) for r in drivers.settings(spark, k=[1, 2], s=["a", "b"]).orderBy("k", "s").collect()] == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    flags = spark.createDataFrame([([1, 0],), ([0, 1],), (None,), ([],)], "s array<int>").select(drivers.first_flag(F.col("s")).alias("f")).collect()
    assert [r["f"] for r in flags] == [True, False, False, False]
