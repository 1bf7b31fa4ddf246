"""Queries of views, pictures and terrain: suppliers stand for objects, parts for a grid of heights."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracegrid.functions.columns import bounds
from tracegrid.operators import raster, scene
from tracegrid.plans.registry import EV, events, query, r6, table

MONITOR = scene.Monitor(0.0, math.pi / 2, 2.0, 1.5, 20.0)
SIZE, KEY = 1.5, ["event_id"]

VIEW = f"""{EV}, f AS (SELECT event_id, t, value * 2 AS x, 0.0 AS y, hour(ts) * 8.0 AS z FROM ev WHERE event_type = 'view'),
o AS (SELECT s_suppkey AS obj_id, (s_suppkey % 50) * 4.0 AS ox, 1.0 AS oy, (s_suppkey % 37) * 5.0 AS oz, CASE WHEN s_suppkey % 10 = 0 THEN (s_suppkey % 30) * 86400.0 END AS gone FROM supplier),
p AS (SELECT *, sqrt((ox - x) ** 2 + (oy - y) ** 2 + (oz - z) ** 2) AS dist FROM f, o),
a AS (SELECT *, atan2(sin(-atan2(ox - x, oz - z)), cos(-atan2(ox - x, oz - z))) AS lat, pi() / 2 - acos((oy - y) / dist) AS vert FROM p WHERE dist < 20),
w AS (SELECT event_id, obj_id, dist, lat, vert FROM a WHERE abs(lat) < 1.0 AND abs(vert) < 0.75 AND coalesce(t < gone, true))"""


def frames(spark, sf_dir):
    ev = events(spark, sf_dir).where(F.col("event_type") == "view")
    return ev.select("event_id", "t", (F.col("value") * 2).alias("x"), F.lit(0.0).alias("y"), (F.hour("ts") * 8.0).alias("z"))


def places(spark, sf_dir, apart=None):
    """Classes of objects, and the members of each."""
    k = F.col("s_suppkey")
    objects = table(spark, sf_dir, "supplier").select(k.alias("obj_id"), ((k % 50) * 4.0).alias("x"), F.lit(1.0).alias("y"), ((k % 37) * 5.0).alias("z"))
    rewards = objects.where(F.col("obj_id") % 10 == 0).select("x", "y", "z", F.col("obj_id"), ((F.col("obj_id") % 30) * 86400.0).alias("t"))
    # Places repeat in the fixture, so the id goes along as the session.
    return scene.classed(scene.rewarded_at(objects, rewards, ["obj_id"], "t"), [], apart)


def view(spark, sf_dir, apart=None):
    """What frames show, a row for each class of objects."""
    return scene.in_view(frames(spark, sf_dir), places(spark, sf_dir, apart)[0], [], MONITOR)


@query(f"WITH {VIEW} SELECT event_id, obj_id, round(dist, 6) AS dist, round(lat, 6) AS lat, round(vert, 6) AS vert FROM w")
def q27_fov_join(spark, sf_dir):
    sites, members = places(spark, sf_dir)
    rows = scene.in_view(frames(spark, sf_dir), sites, [], MONITOR).select("event_id", "obj_id", r6("dist", "dist"), r6("lat", "lat"), r6("vert", "vert"))
    return scene.expanded(rows, members, []).select("event_id", "obj_id", "dist", "lat", "vert")


@query(f"""WITH {VIEW}, m AS (SELECT event_id, arg_min(w, {{'d': dist, 'o': obj_id}}) AS s FROM w GROUP BY event_id)
SELECT event_id, CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS presence, round(coalesce(s.lat, 0), 6) AS lat, round(coalesce(s.vert, 0), 6) AS vert, round(coalesce(s.dist, 0), 6) AS dist, round(coalesce(greatest(0, 1 - s.dist / 20), 0), 6) AS salience FROM f LEFT JOIN m USING (event_id)""")
def q28_collapse_nearest(spark, sf_dir):
    out = scene.side_features(view(spark, sf_dir), frames(spark, sf_dir), KEY, SIZE, MONITOR.clip, "nearest", "salience")
    return out.select("event_id", "presence", *[r6(c, c) for c in ("lat", "vert", "dist", "salience")])


@query(f"""WITH {VIEW}, g AS (SELECT *, 2 * atan2({SIZE}, greatest(dist, 1e-6)) AS q FROM w), m AS (SELECT event_id, sum(q * lat) / sum(q) AS lat, sum(q * vert) / sum(q) AS vert, sum(q * dist) / sum(q) AS dist FROM g GROUP BY 1)
SELECT event_id, CASE WHEN dist IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS presence, round(coalesce(lat, 0), 6) AS lat, round(coalesce(vert, 0), 6) AS vert, round(coalesce(2 * atan2({SIZE}, dist), 0), 6) AS ang_size FROM f LEFT JOIN m USING (event_id)""")
def q29_collapse_salience(spark, sf_dir):
    out = scene.side_features(view(spark, sf_dir), frames(spark, sf_dir), KEY, SIZE, MONITOR.clip, "salience_mean", "angular")
    return out.select("event_id", "presence", *[r6(c, c) for c in ("lat", "vert", "ang_size")])


@query(f"WITH {VIEW} SELECT f.event_id, obj_id, round(max(lat), 6) AS lat, round(max(dist), 6) AS dist FROM f LEFT JOIN w USING (event_id) GROUP BY f.event_id, obj_id")
def q30_per_object_rows(spark, sf_dir):
    """All objects in view, a row each. ``scene.slots`` makes columns of a fixed list of them."""
    sites, members = places(spark, sf_dir)
    rows = scene.slot_rows(scene.in_view(frames(spark, sf_dir), sites, [], MONITOR), frames(spark, sf_dir), KEY, ["lat", "dist"])
    return scene.expanded(rows.select("event_id", "obj_id", r6("lat", "lat"), r6("dist", "dist")), members, [], "left").select("event_id", "obj_id", "lat", "dist")


PIXEL = ["p_size", "p_brand"]


@query("""WITH l AS (SELECT p_size, p_brand, p_partkey % 3 AS layer, max(p_partkey) AS value, min(p_retailprice) AS depth FROM part GROUP BY 1, 2, 3)
SELECT p_size, p_brand, arg_min(value, {'d': depth, 'l': -layer}) AS value, min(depth) AS depth FROM l GROUP BY 1, 2""")
def q31_zbuffer(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(*PIXEL, (F.col("p_partkey") % 3).alias("layer"), F.col("p_partkey").alias("value"), F.col("p_retailprice").alias("depth"))
    return raster.layered(raster.splat(rows, [*PIXEL, "layer"]), PIXEL).select(*PIXEL, "value", "depth")


@query("SELECT p_size, p_brand, CAST(floor(255 * (1 - product(1 - (p_partkey % 97) / 200.0))) AS INT) AS value FROM part GROUP BY 1, 2")
def q32_coverage_product(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(*PIXEL, ((F.col("p_partkey") % 97) / 200.0).alias("c"))
    return raster.uncovered(rows, PIXEL, "c")


H, W, GRID = 50, 40, (6, 5)


def _edges(n, cells):
    e = bounds(n, cells)
    return "[" + ", ".join(map(str, e[1:-1])) + "]"


PIXELS = f"""x AS (SELECT p_size - 1 AS row, CAST(p_partkey % {W} AS INT) AS col, max(p_retailprice) - 1000 AS value FROM part WHERE p_size BETWEEN 1 AND {H} GROUP BY 1, 2),
c AS (SELECT *, len(list_filter({_edges(H, GRID[0])}, lambda e: e <= row)) AS iy, len(list_filter({_edges(W, GRID[1])}, lambda e: e <= col)) AS ix FROM x)"""
SLOPE = "CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN b - value WHEN b IS NULL THEN value - a ELSE (b - a) / 2 END"


def pixels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where(F.col("p_size").between(1, H))
    return rows.groupBy((F.col("p_size") - 1).alias("row"), (F.col("p_partkey") % W).cast("int").alias("col")).agg((F.max("p_retailprice") - 1000).alias("value"))


@query(f"""WITH {PIXELS}, y AS (SELECT *, lag(value) OVER v AS a, lead(value) OVER v AS b FROM c WINDOW v AS (PARTITION BY iy, ix, col ORDER BY row)), y2 AS (SELECT row, col, iy, ix, value, {SLOPE} AS gy FROM y),
z AS (SELECT *, lag(value) OVER v AS a, lead(value) OVER v AS b FROM y2 WINDOW v AS (PARTITION BY iy, ix, row ORDER BY col)), z2 AS (SELECT *, {SLOPE} AS gx FROM z)
SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, round(avg((value > 0)::INT), 6) AS occ, round(avg(value), 5) AS mean, round(avg(sqrt(gx * gx + gy * gy)), 5) AS edge, round(sum(value), 4) AS total FROM z2 GROUP BY iy, ix""")
def q33_grid_pool(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("f", F.lit(0))
    found = raster.cell_statistics(rows, ["f"], H, W, GRID).join(raster.pooled(rows, ["f"], H, W, GRID, ["value"]), ["f", "iy", "ix"])
    return found.select(F.col("iy").cast("bigint").alias("iy"), F.col("ix").cast("bigint").alias("ix"), r6("occ", "occ"), F.round("mean", 5).alias("mean"), F.round("edge", 5).alias("edge"), F.round("value", 4).alias("total"))


def _points(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", ((k * 7) % 60 + 0.3).alias("x"), ((k * 11) % 50 + 0.4).alias("z"))


POINTS = "q AS (SELECT s_suppkey, (s_suppkey * 7) % 60 + 0.3::DOUBLE AS x, (s_suppkey * 11) % 50 + 0.4::DOUBLE AS z FROM supplier)"


@query(f"""WITH {PIXELS}, {POINTS}, d AS (SELECT s_suppkey, value, sqrt((q.x - row) ** 2 + (q.z - col) ** 2) AS dist, row, col FROM q, x AS g)
SELECT s_suppkey, arg_min(value, {{'d': dist, 'z': col, 'x': row}}) AS height, round(min(dist), 6) AS dist FROM d GROUP BY 1""")
def q34_nearest_cell(spark, sf_dir):
    cells = pixels(spark, sf_dir).select(F.col("row").cast("double").alias("x"), F.col("col").cast("double").alias("z"), F.col("value").alias("height"))
    return scene.nearest_cells(_points(spark, sf_dir), cells, ["s_suppkey"], ["height"]).select("s_suppkey", "height", r6("cell_dist", "dist"))


@query(f"""WITH {PIXELS}, {POINTS}, g AS (SELECT r AS gx, c AS gz, coalesce(value, 0) AS h FROM (SELECT unnest(range(0, {H})) AS r), (SELECT unnest(range(0, {W})) AS c) LEFT JOIN x AS g2 ON g2.row = r AND g2.col = c),
k AS (SELECT s_suppkey, greatest(0, least(x, {H - 1} - 1e-6)) AS x, greatest(0, least(z, {W - 1} - 1e-6)) AS z FROM q)
SELECT s_suppkey, round(sum(h * (1 - abs(x - gx)) * (1 - abs(z - gz))), 5) AS height FROM k JOIN g ON gx BETWEEN floor(x) AND floor(x) + 1 AND gz BETWEEN floor(z) AND floor(z) + 1 GROUP BY 1""")
def q35_bilinear(spark, sf_dir):
    full = spark.range(H * W).select(F.floor(F.col("id") / W).cast("int").alias("row"), (F.col("id") % W).cast("int").alias("col"))
    grid = full.join(pixels(spark, sf_dir), ["row", "col"], "left").select(F.col("row").alias("gx"), F.col("col").alias("gz"), F.coalesce("value", F.lit(0.0)).alias("height"))
    return scene.bilinear(_points(spark, sf_dir), grid, ["s_suppkey"], "height", H, W).select("s_suppkey", F.round("height", 5).alias("height"))


N = 21
COVER = lambda p, lo, hi: f"least(1.0, greatest(0.0, least({p} + 0.5, {hi}) - greatest({p} - 0.5, {lo})))"


@query(f"""WITH {VIEW}, b AS (SELECT *, (1.0 - lat) / 2.0 * {N - 1} AS cx, (0.75 - vert) / 1.5 * {N - 1} AS cy, atan2({SIZE}, dist) / 2.0 * {N - 1} AS hx, atan2(1.0, dist) / 1.5 * {N - 1} AS up, atan2(0.5, dist) / 1.5 * {N - 1} AS down FROM w),
x AS (SELECT event_id, row, col, dist, {COVER('col', 'cx - hx', 'cx + hx')} * {COVER('row', 'cy - up', 'cy + down')} AS c FROM b, (SELECT unnest(range(0, {N})) AS row), (SELECT unnest(range(0, {N})) AS col))
SELECT event_id, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS light, round(min(depth), 6) AS depth FROM (SELECT event_id, row, col, CAST(round(255 * (1 - product(1 - c))) AS INT) // 8 AS v, min(dist) AS depth FROM x WHERE c > 1e-9 GROUP BY ALL) GROUP BY event_id""")
def q54_silhouettes(spark, sf_dir):
    """Light and depth of each rendered picture; levels are coarsened, as products of floats come in any order."""
    rows = raster.silhouettes(view(spark, sf_dir), KEY, MONITOR, N, N, SIZE, 2.0, 0.5, raw=True).where("cover > 1e-9")
    out = rows.withColumn("v", F.floor(F.round(255 * F.col("cover")).cast("int") / 8))
    return out.groupBy("event_id").agg(F.count("*").alias("pixels"), F.sum("v").cast("bigint").alias("light"), r6(F.min("depth"), "depth"))


@query()
def q55_flow(spark, sf_dir):
    """Motion of a picture of events by hour and user, from day to day, in 4 x 4 cells."""
    full = spark.range(30 * 24 * 20).select(F.floor(F.col("id") / 480).cast("int").alias("day"), F.floor((F.col("id") % 480) / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"))
    ev = events(spark, sf_dir)
    n = ev.groupBy(F.floor(F.col("t") / 86400).cast("int").alias("day"), F.hour("ts").alias("row"), (F.col("user_id") % 20).cast("int").alias("col")).agg(F.count("*").cast("double").alias("value"))
    movie = full.join(n, ["day", "row", "col"], "left").na.fill(0.0, ["value"]).withColumn("side", F.lit(0))
    return raster.flow(movie, ["side"], "day", 24, 20, (4, 4)).drop("side")
