"""Queries of feature and visual blocks on another clock, motion of what is in view, tuning, and small rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracegrid.operators import clustering, decoding, drivers, ensembles, features, movies, scene, terrain
from tracegrid.operators.ordered import positions
from tracegrid.operators.settle import settled
from tracegrid.plans.registry import DAY, EV, events, query, r6, series, table
from tracegrid.plans.scenes import MONITOR, SIZE, VIEW, frames, view

SIDES = f"""{EV}, s AS (SELECT user_id, k, t, (event_type <> 'error')::DOUBLE AS presence, CASE WHEN event_type <> 'error' THEN value / 100 ELSE 0 END AS lat, CASE WHEN event_type <> 'error' THEN hour(ts) / 24.0 ELSE 0 END AS vert, CASE WHEN event_type <> 'error' THEN value / 10 + 1 ELSE 0 END AS dist FROM ev),
w AS (SELECT *, t - lag(t) OVER v AS hs, lead(t) OVER v - t AS hd, lag(lat) OVER v AS lat_a, lead(lat) OVER v AS lat_b, lag(vert) OVER v AS vert_a, lead(vert) OVER v AS vert_b, lag(dist) OVER v AS dist_a, lead(dist) OVER v AS dist_b FROM s WINDOW v AS (PARTITION BY user_id ORDER BY k))"""


def _slope(y):
    return f"(CASE WHEN hs IS NULL THEN ({y}_b - {y}) / hd WHEN hd IS NULL THEN ({y} - {y}_a) / hs ELSE (hs * hs * {y}_b + (hd * hd - hs * hs) * {y} - hd * hd * {y}_a) / (hs * hd * (hd + hs)) END)"


@query(f"""WITH {SIDES}, g AS (SELECT user_id, k, presence, {_slope('lat')} AS a, {_slope('vert')} AS b, {_slope('dist')} AS c FROM w)
SELECT user_id, k, CASE WHEN presence > 0 THEN round(1000 * a, 4) + 0.0 ELSE 0.0 END AS d_lat, CASE WHEN presence > 0 THEN round(1000 * b, 4) + 0.0 ELSE 0.0 END AS d_vert, CASE WHEN presence > 0 THEN round(1000 * c, 4) + 0.0 ELSE 0.0 END AS d_dist, CASE WHEN presence > 0 THEN round(1000 * sqrt(a * a + b * b), 4) + 0.0 ELSE 0.0 END AS mag,
CASE WHEN presence > 0 THEN round(sin(atan2(b, a)), 5) + 0.0 ELSE 0.0 END AS dir_sin, CASE WHEN presence > 0 THEN round(cos(atan2(b, a)), 5) + 0.0 ELSE 0.0 END AS dir_cos FROM g""")
def q125_motion_features(spark, sf_dir):
    """How what is in view moves; errors show nothing."""
    there = F.col("event_type") != "error"
    side = series(spark, sf_dir).select("user_id", "k", "t", there.cast("double").alias("presence"), F.when(there, F.col("value") / 100).otherwise(0.0).alias("lat"), F.when(there, F.hour("ts") / 24.0).otherwise(0.0).alias("vert"), F.when(there, F.col("value") / 10 + 1).otherwise(0.0).alias("dist"))
    out = drivers.motion_features(side, ["user_id"], "k", "t", None, 0.0)
    return out.select("user_id", "k", *[(F.round(1000 * F.col(c), 4) + 0.0).alias(n) for c, n in (("d_lat", "d_lat"), ("d_vert", "d_vert"), ("d_dist", "d_dist"), ("motion_mag", "mag"))], *[(F.round(f"motion_{c}", 5) + 0.0).alias(c) for c in ("dir_sin", "dir_cos")])


def behaviour(spark, sf_dir):
    """The frames of views, in order of time, with their place and what a block of counts counts."""
    fr = frames(spark, sf_dir).where("t is not null").withColumn("heading", F.col("x") / 10)
    rows = positions(fr, [], "t", ["event_id"], "pos", DAY)
    return settled(rows.withColumn("even", (F.col("event_id") % 2 == 0).cast("double")))


def seen(spark, sf_dir, apart=None):
    beh = behaviour(spark, sf_dir)
    return beh, settled(view(spark, sf_dir, apart).select("event_id", "obj_id", "n", "lat", "vert", "dist").join(beh.select("event_id", "pos"), "event_id").drop("event_id"))


def clock(spark, sf_dir):
    """The other clock: times of sign-ups."""
    return events(spark, sf_dir).where((F.col("event_type") == "signup") & F.col("t").isNotNull()).select(F.col("t").alias("at")).distinct()


@query(f"""WITH {VIEW}, z AS (SELECT *, 2 * atan2({SIZE}, greatest(dist, 1e-6)) AS q FROM w), m AS (SELECT event_id, sum(q * lat) / sum(q) AS lat, sum(q * vert) / sum(q) AS vert, sum(q * dist) / sum(q) AS dist FROM z GROUP BY 1),
b AS (SELECT f.event_id, t, CASE WHEN dist IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS presence, coalesce(lat, 0) AS lat, coalesce(vert, 0) AS vert, coalesce(2 * atan2({SIZE}, dist), 0) AS ang FROM f LEFT JOIN m USING (event_id)),
c AS (SELECT DISTINCT t AS tau FROM ev WHERE event_type = 'signup'), pr AS (SELECT c.tau, b.* FROM c ASOF LEFT JOIN b ON c.tau >= b.t), nx AS (SELECT c.tau, b.* FROM c ASOF LEFT JOIN b ON c.tau <= b.t),
j AS (SELECT pr.tau, pr.t AS t0, nx.t AS t1, CASE WHEN pr.t IS NULL THEN nx.presence WHEN nx.t IS NULL OR pr.tau - pr.t <= nx.t - pr.tau THEN pr.presence ELSE nx.presence END AS presence,
CASE WHEN pr.t IS NULL THEN nx.lat WHEN nx.t IS NULL OR nx.t = pr.t THEN pr.lat ELSE pr.lat + (nx.lat - pr.lat) * (pr.tau - pr.t) / (nx.t - pr.t) END AS lat, CASE WHEN pr.t IS NULL THEN nx.ang WHEN nx.t IS NULL OR nx.t = pr.t THEN pr.ang ELSE pr.ang + (nx.ang - pr.ang) * (pr.tau - pr.t) / (nx.t - pr.t) END AS ang FROM pr JOIN nx USING (tau))
SELECT round(j.tau, 6) AS "at", presence, round(CASE WHEN presence > 0 THEN lat END, 5) AS lat, round(CASE WHEN presence > 0 THEN ang END, 5) AS ang_size FROM j""")
def q126_feature_block(spark, sf_dir):
    """The block of what one side sees, read off at the other clock's times."""
    beh, shown = seen(spark, sf_dir)
    agg = drivers.feature_blocks({"R": shown}, beh, clock(spark, sf_dir), [], "pos", "t", "at", SIZE, MONITOR.clip, bucket=DAY)["agg"]
    return agg.select(r6("at", "at"), F.col("presence_R").alias("presence"), F.round("lat_R", 5).alias("lat"), F.round("ang_size_R", 5).alias("ang_size"))


@query()
def q127_all_blocks(spark, sf_dir):
    """Rows, columns and gaps of every block of features, pictures, motion, objects and counts among them."""
    beh, shown = seen(spark, sf_dir, [3])
    pictures = beh.select("pos", F.array(*[F.sin(F.col("x") * (k + 1) / 40 + F.col("z") / (k + 3)) for k in range(12)]).alias("v"))
    blocks = drivers.feature_blocks({"R": shown}, beh, clock(spark, sf_dir), [], "pos", "t", "at", SIZE, MONITOR.clip, pictures=pictures, n_pix=4, pix_slopes=2.0, motion=2.0, objects=[3], self_moving=2.0, counts=["even"], bucket=DAY)
    out = None
    for name, df in sorted(blocks.items()):
        values = [c for c in df.columns if c != "at"]
        one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in values])
        one = one.select(F.lit(name).alias("block"), "n", F.lit(len(values)).alias("columns"), (F.col("n") * len(values) - sum((F.col(c) for c in values), F.lit(0))).alias("gaps"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def q128_visual_blocks(spark, sf_dir):
    """Blocks of pictures of events by hour and user, a picture a day, read off at noon."""
    full = spark.range(30 * 24 * 20).select(F.floor(F.col("id") / 480).cast("int").alias("day"), F.floor((F.col("id") % 480) / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"))
    n = events(spark, sf_dir).groupBy(F.floor(F.col("t") / 86400).cast("int").alias("day"), F.hour("ts").alias("row"), (F.col("user_id") % 20).cast("int").alias("col")).agg(F.count("*").cast("double").alias("value"))
    movie = settled(full.join(n, ["day", "row", "col"], "left").na.fill(0.0, ["value"]))
    days = movie.select("day").distinct()
    specs = {"grid": {"grid": (3, 4)}, "flow": {"grid": (2, 2), "method": "farneback", "n_pca": 3}, "pixels": {"n_pca": 5}}
    found = movies.visual_blocks({"one": movie}, days.withColumn("t", F.col("day") * 86400.0), days.select((F.col("day") * 86400.0 + 43200).alias("at")), [], "day", "t", "at", 24, 20, specs)
    out = None
    for name, df in found.items():
        one = df.select(F.lit(name).alias("block"), "at", F.transform("v", lambda x: F.round(F.abs(x), 4)).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def q129_tuned(spark, sf_dir):
    """Which kinds of events follow which hours: mean counts by minute of ten after each hour's start, against means of random hours."""
    ev = events(spark, sf_dir).where("t is not null")
    trial, rel = F.floor(F.col("t") / 36000).cast("int"), F.floor(F.col("t") % 36000 / 3600).cast("int")
    n = ev.groupBy(F.col("event_type").alias("cell"), trial.alias("trial"), rel.alias("rel")).agg(F.count("*").cast("double").alias("value"))
    every = n.select("cell", "trial").distinct().withColumn("rel", F.explode(F.sequence(F.lit(0), F.lit(9))))
    rows = settled(every.join(n, ["cell", "trial", "rel"], "left").na.fill(0.0, ["value"]).withColumn("kind", (F.col("trial") % 3).cast("int")))
    return drivers.tuned(rows, "cell", "kind", "trial", "rel", "value", [0, 1, 2], (0, 9), 200).select("cell", "kind", "at", r6("peak", "peak"), r6("threshold", "threshold"), "tuned")


@query("""WITH c AS (SELECT o_orderkey, floor(o_totalprice) / 1000 AS a, o_custkey % 7 / 10.0 AS b, o_orderkey % 5 / 10.0 AS c FROM orders)
SELECT o_orderkey, round(a, 6) AS ax, round(b, 6) AS ay, round(c, 6) AS az FROM c""")
def q130_sensor_inverse(spark, sf_dir):
    """Four sensor readings of a turn, and the turn that least squares make of them again."""
    where = drivers.sensor_directions()
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice") / 1000).alias("a"), (F.col("o_custkey") % 7 / 10.0).alias("b"), (F.col("o_orderkey") % 5 / 10.0).alias("c"))
    rows = rows.withColumns({f"s{k}": F.col("a") * d[0] + F.col("b") * d[1] + F.col("c") * d[2] for k, d in enumerate(where)})
    return drivers.from_projections(rows, [f"s{k}" for k in range(4)], where).select("o_orderkey", *[F.round(F.col(c) + 0.0, 6).alias(c) for c in ("ax", "ay", "az")])


@query(f"""WITH o AS (SELECT s_suppkey AS obj_id, s_suppkey % 4 AS kind, (s_suppkey % 21) - 10.0 AS x, 1.0 AS y, (s_suppkey % 13) + 1.0 AS z FROM supplier), v AS (SELECT p_size % 4 AS kind, p_partkey AS vertex, (p_partkey % 5) / 5.0 AS vx, (p_partkey % 7) / 7.0 AS vy, (p_partkey % 3) / 3.0 AS vz FROM part WHERE p_partkey <= 150),
p AS (SELECT obj_id, vertex, x + vx AS x, y + vy AS y, z + vz AS z FROM o JOIN v USING (kind)), a AS (SELECT obj_id, vertex, atan2(x, z) AS p, acos(y / sqrt(x * x + y * y + z * z)) - {math.pi / 2} AS t FROM p)
SELECT obj_id, CAST(vertex AS BIGINT) AS vertex, round(tan(p), 6) AS u, round(tan(t), 6) AS v FROM a WHERE abs(p) < 0.7""")
def q131_vertices(spark, sf_dir):
    """Vertices of objects' shapes on the tangent plane ahead."""
    k = F.col("s_suppkey")
    objects = table(spark, sf_dir, "supplier").select(k.alias("obj_id"), (k % 4).alias("kind"), (k % 21 - 10.0).alias("x"), F.lit(1.0).alias("y"), (k % 13 + 1.0).alias("z"))
    p = F.col("p_partkey")
    shapes = table(spark, sf_dir, "part").where("p_partkey <= 150").select((F.col("p_size") % 4).alias("kind"), p.alias("vertex"), (p % 5 / 5.0).alias("x"), (p % 7 / 7.0).alias("y"), (p % 3 / 3.0).alias("z"))
    return drivers.vertices_in_view(objects, shapes, 0.0, math.pi / 2, 1.4).select("obj_id", F.col("vertex").cast("bigint").alias("vertex"), r6("u", "u"), r6("v", "v"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS corner, CAST(user_id AS DOUBLE) + CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS x, round(user_id + 0.5::DOUBLE, 6) AS centre_x FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 1, user_id + 1.0::DOUBLE, round(user_id + 0.5::DOUBLE, 6) FROM events WHERE event_type = 'click'""")
def q132_corners(spark, sf_dir):
    """Corner lists in JSON, and the middle of each; other texts have none."""
    u = F.col("user_id").cast("string")
    ev = events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "click", F.concat(F.lit("[["), u, F.lit(", 0], ["), (F.col("user_id") + 1).cast("string"), F.lit(", 2]]"))).otherwise(F.col("event_type")).alias("text"))
    return drivers.corners(ev, ["event_id"], "text").select("event_id", "corner", "x", r6("centre_x", "centre_x"))


@query("SELECT s_nationkey AS nation, CAST(row_number() OVER (ORDER BY max(s_acctbal) DESC, s_nationkey) AS INT) AS rank FROM supplier GROUP BY 1")
def q133_ranked_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("value"))
    return ensembles.ranked_cells(rows, "nation", "value").select("nation", "rank")


@query(f"WITH {VIEW} SELECT DISTINCT event_id FROM w WHERE dist < 6")
def q134_near_frames(spark, sf_dir):
    return scene.near_frames(view(spark, sf_dir), ["event_id"], 6.0).select("event_id")


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value FROM events), p AS (SELECT k // 4 AS period, k FROM (SELECT DISTINCT k FROM t)) SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM t WHERE value IS NOT NULL GROUP BY user_id""")
def q135_scrambled_totals(spark, sf_dir):
    """Scrambled values keep their series and their sum."""
    rows = decoding.scrambled(series(spark, sf_dir).select("user_id", "k", "value"), ["user_id"], "k", ["value"], 3)
    return rows.where("value is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT o_orderkey, round((0.6 - (o_totalprice % 100) / 100) / 1.2 * 30, 6) AS pixel, CAST(round_even((0.6 - (o_totalprice % 100) / 100) / 1.2 * 30, 0) AS INT) AS whole FROM orders")
def q136_label_projection(spark, sf_dir):
    """Where angles fall on a screen, before and after rounding."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_totalprice") % 100) / 100).alias("a"))
    return rows.select("o_orderkey", r6(terrain.projected("a", 1.2, 31), "pixel"), terrain.pixel("a", 1.2, 31).alias("whole"))


@query("SELECT a.sigma, b.embargo, c.k FROM (SELECT unnest([0.0::DOUBLE, 1.5]) AS sigma) a, (SELECT unnest([0::BIGINT, 10]) AS embargo) b, (SELECT DISTINCT n_regionkey::BIGINT AS k FROM nation) c")
def q137_settings(spark, sf_dir):
    """Every combination of two settings with the regions of a table."""
    regions = sorted(r[0] for r in table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint")).distinct().collect())
    return drivers.settings(spark, sigma=[0.0, 1.5], embargo=[0, 10], k=regions)


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t, value FROM events), l AS (SELECT *, coalesce(value - first_value(value) OVER (PARTITION BY user_id ORDER BY k), NULL) AS v FROM s)
SELECT user_id, count(v) AS n FROM l GROUP BY user_id""")
def q138_normalised_trace(spark, sf_dir):
    """Length of each trace that is moved to 0, smoothed and scaled."""
    rows = features.normalised_trace(series(spark, sf_dir), ["user_id"], "k", "value", "y", 2.0)
    return rows.where(F.col("value").isNotNull()).groupBy("user_id").agg(F.count("y").alias("n"))


@query("""WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice AS p FROM orders), c AS (SELECT p AS x, count(*) AS n FROM x GROUP BY 1), m AS (SELECT sum(x * n) / sum(n) AS m, sum(n) AS n FROM c),
r AS (SELECT x, sum(c.n) OVER (ORDER BY x) AS a, sum((x - m) * c.n) OVER (ORDER BY x) AS s, m.n AS n, m FROM c, m), b AS (SELECT * FROM r WHERE a < n ORDER BY s * s / a + s * s / (n - a) DESC, x LIMIT 1), l AS (SELECT m + s / a AS lo, m - s / (n - a) AS hi FROM b)
SELECT CAST((p > (lo + hi) / 2) AS INT) AS level, count(*) AS n FROM x, l GROUP BY 1""")
def q139_level_counts(spark, sf_dir):
    """How many orders belong to each of two levels of price."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x"))
    found = clustering.levels(rows, "x", 2)
    return rows.groupBy(clustering.nearest_level(F.col("x"), found).alias("level")).agg(F.count("*").alias("n"))
