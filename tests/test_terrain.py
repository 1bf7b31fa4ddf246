"""Terrain in view, finer grids and offsets against brute force in NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import scene, terrain

MONITOR = scene.Monitor(0.4, math.pi / 2 - 0.1, 1.6, 1.1, 6.0)


def view_of(frames, cells, m, eye):
    out = set()
    for k, x, y, z, phi in frames:
        for cx, h, cz in cells:
            d = np.array([cx - x, h - y - eye, cz - z])
            r = math.sqrt(d @ d)
            lat = (phi - math.atan2(d[0], d[2]) + math.pi) % (2 * math.pi) - math.pi
            vert = m.theta - math.atan2(math.hypot(d[0], d[2]), d[1])
            if 1e-6 < r < m.clip and abs(lat) < m.h_fov / 2 and abs(vert) < m.v_fov / 2:
                out.add((k, cx, cz))
    return out


@pytest.mark.parametrize("tiles", [1, 4, 7])
def test_in_cone(spark, tiles):
    rng = np.random.default_rng(tiles)
    frames = [(k, *map(float, rng.uniform(-8, 8, 3) * [1, 0.2, 1]), float(rng.uniform(-math.pi, math.pi))) for k in range(60)] + [(99, 0.0, 0.0, 0.0, math.pi)]
    cells = [(float(x), float(rng.normal()), float(z)) for x in range(-12, 13) for z in range(-12, 13)]
    f = spark.createDataFrame([(*r, "s") for r in frames] + [(100, None, 0.0, 0.0, 0.0, "s")], "k int, x double, y double, z double, phi double, session string")
    c = spark.createDataFrame([(*r, "s") for r in cells] + [(1.0, 0.0, 1.0, "other"), (None, 0.0, 1.0, "s")], "x double, height double, z double, session string")
    found = terrain.in_cone(f, c, ["session"], MONITOR, "phi", eye=0.5, tiles=tiles)
    rows = [(r["k"], r["cell_x"], r["cell_z"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == view_of(frames, cells, MONITOR, 0.5)
    assert len(rows) > 200


def test_tiles_out_of_view_are_not_joined(spark):
    """One narrow frame asks for few of the 81 tiles about it."""
    narrow = scene.Monitor(0.0, math.pi / 2, 0.3, 1.0, 8.0)
    f = spark.createDataFrame([(1, 0.5, 0.0, 0.5)], "k int, x double, y double, z double")
    c = spark.createDataFrame([(float(x), 0.0, float(z)) for x in range(-12, 13) for z in range(-12, 13)], "x double, height double, z double")
    plan = terrain.in_cone(f, c.hint("merge"), [], narrow)
    assert plan.count() > 0
    asked = terrain.in_cone(f, c.groupBy().agg(F.lit(0.0).alias("x"), F.lit(0.0).alias("height"), F.lit(0.0).alias("z")), [], narrow)
    assert asked.count() == 0


def test_pixels_and_boxes(spark):
    view = spark.createDataFrame([(1, 0.0, 0.0, 3.0), (1, 0.79, 0.54, 2.0), (1, 0.0, 0.0, 1.5), (2, -0.79, -0.54, 5.99)], "k int, lat double, vert double, dist double")
    px = terrain.painted_points(view, ["k"], MONITOR, 101, 51)
    rows = {(r["k"], r["row"], r["col"]): (r["value"], r["depth"]) for r in px.collect()}
    assert rows == {(1, 25, 50): (150, 1.5), (1, 0, 1): (133, 2.0), (2, 50, 99): (0, 5.99)}
    frames = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    found = {r["k"]: tuple(r)[1:] for r in terrain.boxes(px, frames, ["k"]).collect()}
    assert found == {1: (2, 0, 25, 1, 50, 1.5), 2: (1, 50, 50, 99, 99, 5.99), 3: (0, None, None, None, None, None)}
    wide = terrain.painted_points(view.where("k = 2"), ["k"], MONITOR, 101, 51, point=2)
    assert {(r["row"], r["col"]) for r in wide.collect()} == {(r, c) for r in (49, 50) for c in (98, 99, 100)}


def grid_of(spark, h, chunk=0):
    return spark.createDataFrame([(chunk, i, j, float(h[i, j])) for i in range(h.shape[0]) for j in range(h.shape[1])], "chunk int, gx int, gz int, height double")


def bilinear(h, x, z):
    x, z = np.clip(x, 0, h.shape[0] - 1 - 1e-6), np.clip(z, 0, h.shape[1] - 1 - 1e-6)
    i, j = np.floor(x).astype(int), np.floor(z).astype(int)
    tx, tz = x - i, z - j
    return h[i, j] * (1 - tx) * (1 - tz) + h[i + 1, j] * tx * (1 - tz) + h[i, j + 1] * (1 - tx) * tz + h[i + 1, j + 1] * tx * tz


@pytest.mark.parametrize("stride", [0.5, 0.3, 1.0, 2.0])
def test_upsampled(spark, stride):
    h = np.random.default_rng(3).normal(size=(7, 5))
    found = terrain.upsampled(grid_of(spark, h).unionByName(grid_of(spark, h * 2, 1)), ["chunk"], 7, 5, stride).collect()
    mx, mz = round(7 / stride), round(5 / stride)
    assert len(found) == 2 * mx * mz and len({(r["chunk"], r["gx"], r["gz"]) for r in found}) == len(found)
    for r in found:
        x, z = r["gx"] * 6 / (mx - 1), r["gz"] * 4 / (mz - 1)
        assert (r["x"], r["z"]) == pytest.approx((x, z))
        assert r["height"] == pytest.approx((r["chunk"] + 1) * bilinear(h, np.array(x), np.array(z)), abs=1e-5)


def test_offset_sweep(spark):
    rng = np.random.default_rng(4)
    h = rng.normal(size=(12, 9)).cumsum(axis=0)
    x, z = rng.uniform(-2, 13, 3000), rng.uniform(-2, 10, 3000)
    y = bilinear(h, x + 2, z - 1) + 0.4 + 0.01 * rng.normal(size=3000)
    points = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, y, strict=True)] + [(None, 1.0, 1.0)], "x double, z double, y double")
    offsets = [(a, b) for a in range(-3, 4) for b in range(-3, 4)]
    grid = grid_of(spark, h).drop("chunk")
    sweep = {(r["ox"], r["oz"]): (r["mean"], r["std"]) for r in terrain.offset_moments(points, grid, offsets, 12, 9).collect()}
    for a, b in offsets:
        delta = y - bilinear(h, x + a, z + b)
        assert sweep[a, b] == pytest.approx((delta.mean(), delta.std()), abs=1e-6)
    some = [(2, -1), (0, 0), (-3, 3)]
    deltas = terrain.offset_deltas(points, grid, some, 12, 9)
    peaks = {(r["ox"], r["oz"]): r for r in terrain.offset_peaks(deltas, 50, 0.0).collect()}
    for a, b in some:
        delta = y - bilinear(h, x + a, z + b)
        n, edges = np.histogram(delta, bins=50)
        assert peaks[a, b]["median"] == pytest.approx(np.median(delta), abs=1e-9)
        assert peaks[a, b]["peak"] == pytest.approx((edges[n.argmax()] + edges[n.argmax() + 1]) / 2, abs=(edges[1] - edges[0]) * 1.01)
    whole = terrain.offset_moments(points, grid, some, 12, 9).join(terrain.offset_peaks(deltas), ["ox", "oz"])
    assert {r["rule"]: (r["ox"], r["oz"]) for r in terrain.best_offsets(whole, 0.4).collect()} == dict.fromkeys(("std", "median", "peak"), (2, -1))


def test_frames_are_dealt_out_by_the_pixels_they_paint(spark):
    """More frames are more parts, not larger ones, and a frame's pixels stay where it is."""
    rows = spark.range(600).selectExpr("id as k", "double(id % 7) as x", "0.0D as y", "double(id % 5) as z")
    for n, parts in ((60, 6), (600, 60), (0, 1)):
        f = terrain.dealt(rows.limit(n), ["k"], 10, 100)
        assert f.rdd.getNumPartitions() == parts and f.distinct().count() == n
    c = spark.createDataFrame([(float(x), 0.0, float(z)) for x in range(-12, 13) for z in range(-12, 13)], "x double, height double, z double")
    seen = lambda f: terrain.painted_points(terrain.in_cone(f, F.broadcast(c), [], MONITOR), ["k"], MONITOR, 41, 31, point=2)
    px = seen(terrain.dealt(rows, ["k"], 41 * 31, 1 << 16))
    assert px._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert px.exceptAll(seen(rows)).count() == 0 and seen(rows).count() == px.count() > 0


def test_q97_paints_dealt_frames(spark):
    from tracegrid.plans import catalogue

    plan = catalogue.queries()["q97_terrain_pixels"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(event_id") == 1 and "REPARTITION_BY_NUM" in plan
