"""Queries of terrain in view, finer grids, offsets and movies: parts stand for terrain and pictures, events for frames."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracegrid.operators import clustering, movies, scene, terrain
from tracegrid.plans.registry import EV, events, query, r6, table

GROUND = scene.Monitor(0.0, math.pi / 2, 1.4, 1.2, 12.0)
W, H, BRIGHT = 41, 31, 200

CELLS = "g AS (SELECT (p_size - 1) * 2.0::DOUBLE AS cx, CAST(p_partkey % 40 AS DOUBLE) * 2 AS cz, max(p_retailprice) / 200 - 8 AS h FROM part GROUP BY 1, 2)"
SEEN = f"""{EV}, f AS (SELECT event_id, value AS x, 0.5 AS y, hour(ts) * 3.0 AS z, (event_id % 63) / 10.0 AS phi FROM ev WHERE event_type = 'purchase'), {CELLS},
p AS (SELECT *, sqrt((cx - x) ** 2 + (h - y) ** 2 + (cz - z) ** 2) AS dist, phi - atan2(cx - x, cz - z) AS a, {GROUND.theta} - atan2(sqrt((cx - x) ** 2 + (cz - z) ** 2), h - y) AS vert FROM f JOIN g ON abs(cx - x) < 12 AND abs(cz - z) < 12),
w AS (SELECT *, atan2(sin(a), cos(a)) AS lat FROM p WHERE dist < 12 AND dist > 1e-6), v AS (SELECT * FROM w WHERE abs(lat) < 0.7 AND abs(vert) < 0.6)"""


def ground(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.groupBy(((F.col("p_size") - 1) * 2.0).alias("x"), ((F.col("p_partkey") % 40).cast("double") * 2).alias("z")).agg((F.max("p_retailprice") / 200 - 8).alias("height"))


def walkers(spark, sf_dir):
    ev = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return ev.select("event_id", F.col("value").alias("x"), F.lit(0.5).alias("y"), (F.hour("ts") * 3.0).alias("z"), ((F.col("event_id") % 63) / 10.0).alias("phi"))


def shown(spark, sf_dir):
    frames = terrain.dealt(walkers(spark, sf_dir), ["event_id"], W * H)
    return terrain.in_cone(frames, F.broadcast(ground(spark, sf_dir)), [], GROUND, "phi")  # 2000 places at most


@query(f"WITH {SEEN} SELECT event_id, cx AS cell_x, cz AS cell_z, round(dist, 6) AS dist, round(lat, 6) AS lat, round(vert, 6) AS vert FROM v")
def q95_terrain_cone(spark, sf_dir):
    return shown(spark, sf_dir).select("event_id", "cell_x", "cell_z", r6("dist", "dist"), r6("lat", "lat"), r6("vert", "vert"))


@query(f"""WITH {SEEN}, k AS (SELECT event_id, CAST(round_even((0.6 - vert) / 1.2 * {H - 1}, 0) AS INT) AS row, CAST(round_even((0.7 - lat) / 1.4 * {W - 1}, 0) AS INT) AS col, dist FROM v)
SELECT f.event_id, count(DISTINCT row * 1000 + col) AS n, min(row) AS top, max(row) AS bottom, min(col) AS "left", max(col) AS "right", round(min(dist), 6) AS nearest FROM f LEFT JOIN k USING (event_id) GROUP BY f.event_id""")
def q96_terrain_boxes(spark, sf_dir):
    """Per-frame pixel boxes of the terrain in view."""
    px = terrain.painted_points(shown(spark, sf_dir), ["event_id"], GROUND, W, H, BRIGHT)
    return terrain.boxes(px, walkers(spark, sf_dir), ["event_id"]).select("event_id", "n", "top", "bottom", "left", "right", r6("nearest", "nearest"))


@query(f"""WITH {SEEN}, k AS (SELECT event_id, CAST(round_even((0.6 - vert) / 1.2 * {H - 1}, 0) AS INT) AS row, CAST(round_even((0.7 - lat) / 1.4 * {W - 1}, 0) AS INT) AS col, dist FROM v),
s AS (SELECT event_id, row + i AS row, col + j AS col, dist FROM k, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j))
SELECT event_id, row, col, CAST(floor(greatest(0, {BRIGHT} * (1 - min(dist) / 12))) AS INT) AS value, round(min(dist), 6) AS depth FROM s WHERE row BETWEEN 0 AND {H - 1} AND col BETWEEN 0 AND {W - 1} GROUP BY ALL""")
def q97_terrain_pixels(spark, sf_dir):
    px = terrain.painted_points(shown(spark, sf_dir), ["event_id"], GROUND, W, H, BRIGHT, 2)
    return px.select("event_id", "row", "col", "value", r6("depth", "depth"))


NX, NZ = 10, 8
GRID = f"g AS (SELECT CAST(p_size % {NX} AS INT) AS gx, CAST(p_partkey % {NZ} AS INT) AS gz, avg(p_retailprice) / 100 AS h FROM part GROUP BY 1, 2)"
SURFACE = "s AS (SELECT a.gx, a.gz, a.h AS a, b.h - a.h AS b, c.h - a.h AS c, a.h + d.h - b.h - c.h AS d FROM g a JOIN g b ON b.gx = a.gx + 1 AND b.gz = a.gz JOIN g c ON c.gx = a.gx AND c.gz = a.gz + 1 JOIN g d ON d.gx = a.gx + 1 AND d.gz = a.gz + 1)"


def heights(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.groupBy((F.col("p_size") % NX).cast("int").alias("gx"), (F.col("p_partkey") % NZ).cast("int").alias("gz")).agg((F.avg("p_retailprice") / 100).alias("height"))


@query(f"""WITH {GRID}, {SURFACE}, x AS (SELECT i, i * {NX - 1}.0 / {2 * NX - 1} AS x, least(CAST(floor(i * {NX - 1}.0 / {2 * NX - 1}) AS INT), {NX - 2}) AS gx FROM range({2 * NX}) t(i)),
z AS (SELECT i AS j, i * {NZ - 1}.0 / {2 * NZ - 1} AS z, least(CAST(floor(i * {NZ - 1}.0 / {2 * NZ - 1}) AS INT), {NZ - 2}) AS gz FROM range({2 * NZ}) t(i))
SELECT i AS gx, j AS gz, round(a + b * (x - s.gx) + c * (z - s.gz) + d * (x - s.gx) * (z - s.gz), 6) AS height FROM s JOIN x ON x.gx = s.gx JOIN z ON z.gz = s.gz""")
def q98_terrain_upsampled(spark, sf_dir):
    return terrain.upsampled(heights(spark, sf_dir), [], NX, NZ, 0.5).select("gx", "gz", r6("height", "height"))


OFFSETS = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
DELTA = f"""{EV}, p AS (SELECT value / 8 AS x, hour(ts) / 3.0 AS z, 14 + value / 50 AS y FROM ev WHERE event_type = 'view' AND value IS NOT NULL), {GRID}, {SURFACE},
o AS (SELECT a.v AS ox, b.v AS oz FROM (SELECT unnest(range(-2, 3)) AS v) a, (SELECT unnest(range(-2, 3)) AS v) b),
k AS (SELECT ox, oz, y, greatest(0, least(x + ox, {NX - 1} - 1e-6)) AS x, greatest(0, least(z + oz, {NZ - 1} - 1e-6)) AS z FROM p, o),
d AS (SELECT ox, oz, y - (a + b * (x - gx) + c * (z - gz) + d * (x - gx) * (z - gz)) AS delta FROM k JOIN s ON gx = floor(x) AND gz = floor(z))"""


def walked(spark, sf_dir):
    ev = events(spark, sf_dir).where(F.col("event_type") == "view")
    return ev.select((F.col("value") / 8).alias("x"), (F.hour("ts") / 3.0).alias("z"), (14 + F.col("value") / 50).alias("y"))


@query(f"WITH {DELTA} SELECT CAST(ox AS INT) AS ox, CAST(oz AS INT) AS oz, round(avg(delta), 5) AS mean, round(stddev_pop(delta), 5) AS std FROM d GROUP BY 1, 2")
def q99_offset_sweep(spark, sf_dir):
    """Mean and deviation of all offsets from one pass over the points."""
    return terrain.offset_moments(walked(spark, sf_dir), heights(spark, sf_dir), OFFSETS, NX, NZ).select("ox", "oz", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"""WITH {DELTA}, r AS (SELECT ox, oz, stddev_pop(delta) AS std, median(delta) AS med FROM d GROUP BY 1, 2)
SELECT rule, CAST(ox AS INT) AS ox, CAST(oz AS INT) AS oz FROM (SELECT 'std' AS rule, ox, oz FROM r ORDER BY std, oz, ox LIMIT 1) UNION ALL (SELECT 'median', CAST(ox AS INT), CAST(oz AS INT) FROM r ORDER BY abs(med - 0.4), oz, ox LIMIT 1)""")
def q100_offset_optima(spark, sf_dir):
    points, grid = walked(spark, sf_dir), heights(spark, sf_dir)
    sweep = terrain.offset_moments(points, grid, OFFSETS, NX, NZ).join(terrain.offset_peaks(terrain.offset_deltas(points, grid, OFFSETS, NX, NZ)), ["ox", "oz"])
    return terrain.best_offsets(sweep, 0.4, "std median")


MOVIE = "m AS (SELECT CAST(p_partkey % 6 AS INT) AS frame, p_size - 1 AS row, CAST(p_partkey % 17 AS INT) AS col, avg(p_retailprice) / 100 AS value FROM part WHERE p_size <= 20 GROUP BY 1, 2, 3)"


def movie(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size <= 20")
    return part.groupBy((F.col("p_partkey") % 6).cast("int").alias("frame"), (F.col("p_size") - 1).alias("row"), (F.col("p_partkey") % 17).cast("int").alias("col")).agg((F.avg("p_retailprice") / 100).alias("value"))


def _smooth(sigmas):
    """The weighted mean over all pixels in reach, in one sum over the three axes, as SQL; the axes' kernels are cut at four deviations."""
    axes = [("frame", sigmas[0]), ("row", sigmas[1]), ("col", sigmas[2])]
    on = " AND ".join(f"abs(a.{x} - b.{x}) <= {int(4 * s + 0.5)}" for x, s in axes)
    w = " * ".join(f"exp(-0.5 * ((a.{x} - b.{x}) / {s}) ** 2)" if s else "1" for x, s in axes)
    return f"SELECT a.frame, a.row, a.col, round(sum({w} * b.value) / sum({w}), 6) AS smooth FROM m a JOIN m b ON {on} GROUP BY 1, 2, 3"


@query(f"WITH {MOVIE} {_smooth((0.6, 1.0, 1.5))}")
def q101_movie_smooth(spark, sf_dir):
    """Absent pixels have no weight. Missing positions are filled so that windows of rows are windows of pixels."""
    rows = movie(spark, sf_dir)
    every = F.explode(F.sequence(F.lit(0), F.lit(16)))
    full = rows.select("frame").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("col", every).join(rows, ["frame", "row", "col"], "left")
    out = movies.smoothed_movie(full, [], "frame", "value", "smooth", (0.6, 1.0, 1.5)).where("value is not null")
    return out.select("frame", "row", "col", r6("smooth", "smooth"))


@query(f"WITH {MOVIE}, f AS (SELECT frame, avg(value) AS mean FROM m GROUP BY 1), p AS (SELECT row, col, avg(value) AS mean FROM m WHERE frame < 3 GROUP BY 1, 2) SELECT 'frame' AS kind, frame, NULL::INT AS row, NULL::INT AS col, round(mean, 6) AS mean FROM f UNION ALL SELECT 'pixel', NULL::INT, row, col, round(mean, 6) FROM p")
def q102_movie_means(spark, sf_dir):
    rows, none = movie(spark, sf_dir), F.lit(None).cast("int")
    a = movies.frame_means(rows, [], "frame", "value").select(F.lit("frame").alias("kind"), "frame", none.alias("row"), none.alias("col"), r6("mean", "mean"))
    return a.unionByName(movies.pixel_means(rows, [], "frame", "value", 3).select(F.lit("pixel").alias("kind"), none.alias("frame"), "row", "col", r6("mean", "mean")))


@query()
def q103_dense_flow(spark, sf_dir):
    """Mean motion of the cells of pictures, from the dense field."""
    return movies.dense_flow(movie(spark, sf_dir), [], "frame", 20, 17, (4, 3)).select("frame", "iy", "ix", *[r6(c, c) for c in ("u", "v", "speed", "div")])


@query("SELECT p_size AS row, p_partkey % 11 AS col, round(sum(p_retailprice), 4) AS weight FROM part GROUP BY 1, 2")
def q104_footprint(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("row"), (F.col("p_partkey") % 11).alias("col"), F.col("p_retailprice").alias("weight"))
    return movies.footprint(rows, [], "weight").select("row", "col", F.round("weight", 4).alias("weight"))


@query("""WITH c AS (SELECT value AS x, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), m AS (SELECT sum(x * n) / sum(n) AS m, sum(n) AS n FROM c),
r AS (SELECT x, sum(c.n) OVER (ORDER BY x) AS a, sum((x - m) * c.n) OVER (ORDER BY x) AS s, m.n AS n, m FROM c, m),
b AS (SELECT * FROM r WHERE a < n ORDER BY s * s / a + s * s / (n - a) DESC, x LIMIT 1)
SELECT 0 AS level, round(m + s / a, 6) AS value FROM b UNION ALL SELECT 1, round(m - s / (n - a), 6) FROM b""")
def q105_two_levels(spark, sf_dir):
    """The two means of all values with the least sum of squares."""
    found = clustering.levels(events(spark, sf_dir), "value", 2)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(found)], "level int, value double")


@query()
def q106_levels(spark, sf_dir):
    """Four levels of order prices in hundreds, and how many orders belong to each."""
    rows = table(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice") / 100).alias("x"))
    found = clustering.levels(rows, "x", 4)
    counts = rows.where("x is not null").groupBy(clustering.nearest_level(F.col("x"), found).alias("level")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(spark.createDataFrame([(k, round(v, 4)) for k, v in enumerate(found)], "level int, value double")), "level")
