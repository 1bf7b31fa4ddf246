"""Queries of filters, features and reports over the fixture tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from tracegrid.functions import columns
from tracegrid.operators import ensembles, features, linalg, raster, responses, scene, series as ser, stats
from tracegrid.plans.registry import EV, query, r6, series, table
from tracegrid.plans.statistics import DIMS, _dims

W3 = ser.taps("zeroed", 1.5)
PLAIN = ser.taps("plain", 1.0)
EVEN = ser.taps("even", 1.0)


def taps_sql(weights: list[float]) -> str:
    """Rows (j, w) of a kernel, j from minus to plus its half-width."""
    h = len(weights) // 2
    return "w AS (SELECT * FROM (VALUES " + ", ".join(f"({k - h}, {x!r}::DOUBLE)" for k, x in enumerate(weights)) + ") AS t(j, w))"


@query(f"WITH {EV}, {taps_sql(W3)} SELECT a.event_id, round(sum(b.value * w), 6) AS smooth FROM ev a, w JOIN ev b ON b.user_id = a.user_id AND b.k = a.k + j GROUP BY 1")
def q60_zero_padded_smooth(spark, sf_dir):
    return ser.smoothed(series(spark, sf_dir), ["user_id"], "k", {"s": "value"}, 1.5, "zeroed").select("event_id", r6("s", "smooth"))


@query(f"WITH {EV} SELECT event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY k), 0), 6) AS change FROM ev")
def q61_difference(spark, sf_dir):
    return ser.difference(series(spark, sf_dir), ["user_id"], "k", "value", "d", "value").select("event_id", r6("d", "change"))


@query(f"""WITH {EV}, {taps_sql(PLAIN)}, d AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY k), 0) AS d FROM ev),
s AS (SELECT a.event_id, a.user_id, greatest(sum(b.d * w), 0) AS s FROM d a, w JOIN d b ON b.user_id = a.user_id AND b.k = a.k + j GROUP BY 1, 2),
m AS (SELECT user_id, avg(s) AS a, max(s) AS x FROM s GROUP BY 1) SELECT event_id, round((s - a) / nullif(x - a, 0), 6) AS slope FROM s JOIN m USING (user_id)""")
def q62_rectified_slope(spark, sf_dir):
    return ser.rectified_slope(series(spark, sf_dir), ["user_id"], "k", "value", "s").select("event_id", r6("s", "slope"))


@query(f"""WITH {EV}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1), l AS (SELECT unnest(range(-5, 6)) AS lag)
SELECT a.user_id, lag, CAST(count(*) AS BIGINT) AS product FROM ev a JOIN n USING (user_id), l JOIN ev b ON b.user_id = a.user_id AND b.k = ((a.k + lag) % n + n) % n WHERE a.event_type = 'click' AND b.event_type = 'purchase' GROUP BY 1, 2""")
def q63_lagged_products(spark, sf_dir):
    rows = series(spark, sf_dir)
    rows = rows.join(rows.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").withColumns({"a": (F.col("event_type") == "click").cast("bigint"), "b": (F.col("event_type") == "purchase").cast("bigint")})
    return ser.lagged_products(rows, ["user_id"], "k", "a", "b", 5, "n").select("user_id", F.col("lag").cast("bigint").alias("lag"), "product")


@query(f"""WITH {EV}, p AS (SELECT user_id, arg_max(k, value * 1e6 - k / 1e6) AS top, max(k) AS last FROM ev GROUP BY 1), f AS (SELECT *, greatest(0, least(top - 1, last - 2)) AS lo FROM p)
SELECT user_id, top AS "at", round(avg(value), 6) AS peak FROM f JOIN ev USING (user_id) WHERE k BETWEEN lo AND lo + 2 GROUP BY 1, 2""")
def q64_peak(spark, sf_dir):
    return ser.peak(series(spark, sf_dir), ["user_id"], "k", "value").select("user_id", "at", r6("peak", "peak"))


@query(f"WITH {EV}, d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY k) AS d FROM ev) SELECT user_id, round(coalesce(1 / nullif(median(d), 0), 60), 9) AS fs FROM d GROUP BY 1")
def q65_sampling_rate(spark, sf_dir):
    return ser.sampling_rate(series(spark, sf_dir), ["user_id"], "k", "t").select("user_id", F.round("fs", 9).alias("fs"))


@query(f"WITH {EV}, b AS (SELECT user_id, avg(value) AS b FROM ev WHERE k - 10 >= -10 AND k - 10 < 0 GROUP BY 1) SELECT event_id, round(value - coalesce(b, 0), 6) AS value FROM ev LEFT JOIN b USING (user_id)")
def q66_baseline(spark, sf_dir):
    rows = series(spark, sf_dir).withColumn("rel", F.col("k") - 10)
    return responses.baseline_removed(rows, ["user_id"], "rel", "value", 10).select("event_id", r6("value", "value"))


@query("SELECT event_type, hour(ts) AS rel, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def q67_trial_average(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("rel", F.hour("ts").cast("bigint"))
    return responses.trial_average(rows, ["event_type"], "rel", "value").select("event_type", "rel", r6("value", "value"))


@query("WITH v AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT round(count(*) / (SELECT count(DISTINCT o_orderkey) FROM orders), 6) AS one, round(count(*) FILTER (n >= 2) / (SELECT count(DISTINCT o_orderkey) FROM orders), 6) AS two, max(n) AS most FROM v")
def q68_view_shares(spark, sf_dir):
    frames = table(spark, sf_dir, "orders").select("o_orderkey").distinct().count()
    return scene.view_shares(table(spark, sf_dir, "lineitem"), frames, ["l_orderkey"]).select(r6("one", "one"), r6("two", "two"), "most")


@query("WITH m AS (SELECT event_type, max(value) AS m FROM events GROUP BY 1) SELECT event_id, round(value / nullif(m, 0), 6) AS y FROM events JOIN m USING (event_type)")
def q69_peak_scaled(spark, sf_dir):
    return stats.peak_scaled(table(spark, sf_dir, "events"), ["event_type"], "value", "y").select("event_id", r6("y", "y"))


@query("SELECT event_type, round(quantile_cont(value, 0.0001) + 0.2 * (median(value) - quantile_cont(value, 0.0001)), 6) AS threshold FROM events GROUP BY 1")
def q70_signal_threshold(spark, sf_dir):
    return stats.signal_threshold(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", r6("threshold", "threshold"))


@query("WITH a AS (SELECT median(value) AS m, (max(value) - min(value)) / 10 AS r FROM events), b AS (SELECT median(value) AS m FROM events, a WHERE abs(value - a.m) >= r) SELECT 0 AS place, round(m, 6) AS level FROM a UNION ALL SELECT 1, round(m, 6) FROM b")
def q71_levels(spark, sf_dir):
    found = stats.levels(table(spark, sf_dir, "events"), "value", 2)
    return spark.createDataFrame([(n, round(x, 6)) for n, x in enumerate(found)], "place int, level double")


@query(f"WITH {DIMS} SELECT a.dim, round(avg(r), 5) AS mean FROM (SELECT a.dim AS dim, b.dim AS other, corr(a.x, b.x) AS r FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.dim <> b.dim GROUP BY 1, 2) a GROUP BY 1")
def q72_mean_correlation(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    mean = linalg.mean_correlation(linalg.correlations(rows, "v"))
    return spark.createDataFrame([(k, round(float(x), 5)) for k, x in enumerate(mean)], "dim bigint, mean double")


@query(f"""WITH {taps_sql(EVEN)}, h AS (SELECT event_type, least(floor(value / 5), 19)::BIGINT AS b, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2),
g AS (SELECT event_type, b FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(0, 20)) AS b)),
s AS (SELECT g.event_type, g.b, sum(coalesce(n, 0) * w) AS y FROM g, w LEFT JOIN h ON h.event_type = g.event_type AND h.b = CASE WHEN g.b + j < 0 THEN -1 - g.b - j WHEN g.b + j > 19 THEN 39 - g.b - j ELSE g.b + j END GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(y, 9) DESC, b) AS r FROM s) SELECT event_type, b * 5 + 2.5::DOUBLE AS mode FROM r WHERE r = 1""")
def q73_smoothed_mode(spark, sf_dir):
    return stats.smoothed_mode(table(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 100.0, 20)


TERRAIN = "(SELECT (p_partkey // 40) % 3 * 10 AS chunk_x, 0 AS chunk_z, p_partkey % 5 AS x, p_size % 8 AS z, max(p_retailprice) AS height FROM part GROUP BY ALL)"


def terrain(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / 40) % 3 * 10).alias("chunk_x"), F.lit(0).alias("chunk_z"), (F.col("p_partkey") % 5).alias("x"), (F.col("p_size") % 8).alias("z"), "p_retailprice")
    return rows.groupBy("chunk_x", "chunk_z", "x", "z").agg(F.max("p_retailprice").alias("height"))


@query(f"""WITH t AS {TERRAIN}, c AS (SELECT a.chunk_x, min(b.chunk_x) AS next_x FROM (SELECT DISTINCT chunk_x FROM t) a JOIN (SELECT DISTINCT chunk_x FROM t) b ON b.chunk_x > a.chunk_x GROUP BY 1), m AS (SELECT max(x) AS m FROM t)
SELECT m - a.x AS edge_a, b.x AS edge_b, round(sqrt(avg((a.height - b.height) ** 2)), 6) AS rms FROM t a JOIN c USING (chunk_x), m JOIN t b ON b.chunk_x = next_x AND b.chunk_z = a.chunk_z AND b.z = a.z WHERE a.x > m - 3 AND b.x < 3 GROUP BY 1, 2""")
def q74_seam_rms(spark, sf_dir):
    return scene.seam_rms(terrain(spark, sf_dir)).select("edge_a", "edge_b", r6("rms", "rms"))


@query(f"WITH t AS {TERRAIN}, m AS (SELECT max(x) AS mx, max(z) AS mz FROM t) SELECT chunk_x, x, z, round(chunk_x + x - mx / 2, 6) AS world_x, round(chunk_z + mz - z - mz / 2, 6) AS world_z FROM t, m")
def q75_world_coordinates(spark, sf_dir):
    return scene.world(terrain(spark, sf_dir)).select("chunk_x", "x", "z", r6("world_x", "world_x"), r6("world_z", "world_z"))


@query("SELECT p_brand, round(median(p_retailprice - p_size), 6) AS median, round(avg(p_retailprice - p_size), 6) AS mean, round(stddev_pop(p_retailprice - p_size), 6) AS std, round(quantile_cont(p_retailprice - p_size, 0.05), 6) AS p5, round(quantile_cont(p_retailprice - p_size, 0.95), 6) AS p95 FROM part GROUP BY 1")
def q76_delta_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") - F.col("p_size")).alias("delta"))
    return scene.delta_summary(rows, ["p_brand"], "delta").select("p_brand", *[r6(c, c) for c in ("median", "mean", "std", "p5", "p95")])


@query("SELECT event_id, round(2 * sin(value / 50) * sin(value / 20), 6) AS x, round(2 * cos(value / 50), 6) AS y, round(2 * sin(value / 50) * cos(value / 20), 6) AS z, round(cos(value + 1.5), 6) AS turned FROM events")
def q77_directions(spark, sf_dir):
    x, y, z = columns.cartesian(F.col("value") / 20, F.col("value") / 50, 2.0)
    rows = table(spark, sf_dir, "events").withColumn("phase", F.col("value"))
    return rows.select("event_id", r6(x, "x"), r6(y, "y"), r6(z, "z"), r6(F.cos(responses.phase_with(F.lit(1.5))), "turned"))


@query("WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_id, round(coalesce((value - lo) / nullif(hi - lo, 0) * 255, 0), 6) AS y FROM events JOIN m USING (event_type)")
def q78_scaled(spark, sf_dir):
    return stats.scaled(table(spark, sf_dir, "events"), ["event_type"], "value", "y", 0.0, 255.0).select("event_id", r6("y", "y"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN 'mean' END AS stat, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS row, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 7 AS INT) END AS col FROM part")
def q79_cell_names(spark, sf_dir):
    name = F.concat(F.lit("mean_r"), "p_size", F.when(F.col("p_partkey") % 4 > 0, "c").otherwise("x"), F.col("p_partkey") % 7)
    return table(spark, sf_dir, "part").withColumn("c", columns.cell_name(name)).select("p_partkey", "c.stat", "c.row", "c.col")


GRID = "(SELECT d AS row, h AS col, coalesce(a, 0)::DOUBLE AS a, coalesce(b, 0)::DOUBLE AS b FROM (SELECT * FROM (SELECT unnest(range(0, 30)) AS d), (SELECT unnest(range(0, 24)) AS h)) LEFT JOIN (SELECT day(ts) - 1 AS d, hour(ts) AS h, sum(value) AS a, count(*) AS b FROM events GROUP BY 1, 2) USING (d, h))"
SLOPE = "CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END"


def grid(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy((F.dayofmonth("ts") - 1).alias("row"), F.hour("ts").alias("col")).agg(F.sum("value").alias("a"), F.count("*").alias("b"))
    full = spark.range(720).select(F.floor(F.col("id") / 24).cast("int").alias("row"), (F.col("id") % 24).cast("int").alias("col"))
    return full.join(n, ["row", "col"], "left").select("row", "col", F.coalesce("a", F.lit(0.0)).cast("double").alias("a"), F.coalesce("b", F.lit(0)).cast("double").alias("b"))


@query(f"""WITH g AS {GRID}, r AS (SELECT *, {SLOPE.format(c='a')} AS ar, {SLOPE.format(c='b')} AS br FROM g WINDOW w AS (PARTITION BY col ORDER BY row)),
c AS (SELECT *, {SLOPE.format(c='a')} AS ac, {SLOPE.format(c='b')} AS bc FROM r WINDOW w AS (PARTITION BY row ORDER BY col)) SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(sin(atan2(ar, ac) - atan2(br, bc)), 5) AS sign FROM c""")
def q80_field_sign(spark, sf_dir):
    return responses.field_sign(grid(spark, sf_dir), [], "a", "b").select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.round("sign", 5).alias("sign"))


@query(f"""WITH {DIMS}, p AS (SELECT m.label AS cluster, f.dim AS frame, sum(m.w * f.x) AS score FROM (SELECT label, vec_id AS comp, avg(x) AS w FROM d WHERE dim < 8 GROUP BY 1, 2) m JOIN d f ON f.vec_id = m.comp WHERE f.dim >= 8 GROUP BY 1, 2),
s AS (SELECT cluster, stddev_pop(score) AS s FROM p GROUP BY 1) SELECT cluster, frame, round(score, 6) AS score, abs(score) > 1.5 * s AS active FROM p JOIN s USING (cluster)""")
def q81_cluster_scores(spark, sf_dir):
    rows = _dims(spark, sf_dir)
    loads = rows.where("dim < 8").select(F.col("vec_id").alias("comp"), F.struct("label", "vec_id", "dim").alias("cell"), F.col("x").alias("value"), "label")
    scores = rows.where("dim >= 8").select(F.col("vec_id").alias("comp"), F.col("dim").alias("frame"), F.col("x").alias("value"))
    found = ensembles.projected(loads.drop("label"), scores, loads.select("cell", F.col("label").alias("cluster")).distinct(), "comp", "cell", "frame", "value", 1.5)
    return found.select("cluster", "frame", r6("score", "score"), "active")


@query("""WITH c AS (SELECT CAST(p_size % 3 AS INT) AS iy, CAST(p_partkey % 4 AS INT) AS ix, count(*) AS v FROM part GROUP BY 1, 2),
y AS (SELECT row, CASE WHEN row >= 4 THEN 2 WHEN row >= 2 THEN 1 ELSE 0 END AS iy FROM (SELECT unnest(range(0, 7)) AS row)), x AS (SELECT col, CASE WHEN col >= 6 THEN 3 WHEN col >= 4 THEN 2 WHEN col >= 2 THEN 1 ELSE 0 END AS ix FROM (SELECT unnest(range(0, 9)) AS col))
SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, v FROM c JOIN y USING (iy) JOIN x USING (ix)""")
def q82_painted(spark, sf_dir):
    """Counts of parts in a grid of cells, painted over the cells' pixels."""
    part = table(spark, sf_dir, "part")
    cells = part.groupBy((F.col("p_size") % 3).cast("int").alias("iy"), (F.col("p_partkey") % 4).cast("int").alias("ix")).agg(F.count("*").alias("v"))
    return raster.painted(cells, [], 7, 9, (3, 4), "v")


@query(f"""WITH {EV}, {taps_sql(ser.taps('even', 2.0))}, n AS (SELECT user_id, max(k) AS last FROM ev GROUP BY 1),
s AS (SELECT a.user_id, a.k, sum(w * b.value) AS s FROM ev a JOIN n USING (user_id), w JOIN ev b ON b.user_id = a.user_id AND b.k = greatest(0, least(last, a.k + j)) GROUP BY 1, 2)
SELECT user_id, k, round(s, 6) AS value FROM s""")
def q83_event_features(spark, sf_dir):
    return features.event_features(series(spark, sf_dir), ["user_id"], "k", ["value"], 2.0).select("user_id", "k", r6("value", "value"))


@query(f"""WITH {EV}, d AS (SELECT *, coalesce(value - lag(value) OVER w, 0) / 1000 AS a, coalesce(t - lag(t) OVER w, 0) / 1000 AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT event_id, round(sum(a * 0.5 + b * -2) OVER (PARTITION BY user_id ORDER BY k), 6) AS turn FROM d""")
def q84_sensor_turn(spark, sf_dir):
    return features.turned(series(spark, sf_dir), ["user_id"], "k", ["value", "t"], {"turn": [0.5, -2.0]}).select("event_id", r6("turn_sum", "turn"))


@query(f"""WITH {EV}, p AS (SELECT user_id, i AS period, i * 4 AS first, i * 4 + 3 AS last FROM (SELECT DISTINCT user_id FROM ev), (SELECT unnest(range(0, 3)) AS i)),
m AS (SELECT user_id, period, k, value, t, first_value(value) OVER w AS v0, first_value(t) OVER w AS t0 FROM p JOIN ev USING (user_id) WHERE k BETWEEN first AND last WINDOW w AS (PARTITION BY user_id, period ORDER BY k))
SELECT user_id, period, k, round((value - v0) / nullif(t - t0, 0), 9) AS ratio FROM m""")
def q85_period_ratio(spark, sf_dir):
    rows = series(spark, sf_dir)
    spans = rows.select("user_id").distinct().withColumn("period", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))).withColumns({"first": F.col("period") * 4, "last": F.col("period") * 4 + 3})
    return features.period_ratio(rows, spans, ["user_id"], "k", "value", "t").select("user_id", "period", "k", F.round("ratio", 9).alias("ratio"))


@query("SELECT 'k' AS name, round(avg((v IS NULL)::INT), 6) AS missing, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM (SELECT CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events)")
def q86_missing_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("k"))
    return features.missing_report(rows, ["k"]).select("name", r6("missing", "missing"), "low", "high")


@query("SELECT 'p_size' AS axis, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, max(abs(p_size)) > 200 AS world FROM part UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), max(abs(p_retailprice)) > 200 FROM part")
def q87_world_check(spark, sf_dir):
    return features.world_coordinates(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


@query("SELECT CAST(0 AS INT) AS dset_idx, s_suppkey AS id, s_acctbal AS v FROM supplier UNION ALL SELECT 1, c_custkey, c_acctbal FROM customer")
def q88_stacked(spark, sf_dir):
    return features.stacked([table(spark, sf_dir, n).select(F.col(k).alias("id"), F.col(v).alias("v")) for n, k, v in (("supplier", "s_suppkey", "s_acctbal"), ("customer", "c_custkey", "c_acctbal"))])


@query("SELECT event_id FROM events WHERE event_id % 7 = 0")
def q89_every_nth(spark, sf_dir):
    return features.every_nth(table(spark, sf_dir, "events"), "event_id", 7).select("event_id")


@query(f"WITH t AS {TERRAIN} SELECT chunk_x, x, z, height FROM t WHERE x % 2 = 0 AND z % 2 = 0")
def q90_strided(spark, sf_dir):
    return features.strided(terrain(spark, sf_dir), 2.5).select("chunk_x", "x", "z", "height")


@query(f"WITH g AS {GRID} SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, CASE WHEN row < 3 THEN 255 WHEN row >= 27 THEN 128 ELSE CAST(b AS INT) END AS value FROM g")
def q91_stripes(spark, sf_dir):
    return features.striped(grid(spark, sf_dir).select("row", "col", F.col("b").cast("int").alias("value")), 30)


@query("WITH o AS (SELECT s_suppkey, sqrt((s_acctbal - 10) ** 2 + (s_suppkey % 7 - 1) ** 2 + (s_nationkey - 2) ** 2) AS dist FROM supplier) SELECT s_suppkey, round(dist, 6) AS dist, CAST(row_number() OVER (ORDER BY dist, s_suppkey) AS INT) AS rank FROM o")
def q92_by_distance(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 7).alias("y"), F.col("s_nationkey").alias("z"))
    return features.by_distance(rows, "s_suppkey", (10.0, 1.0, 2.0)).select("s_suppkey", r6("dist", "dist"), "rank")


@query(f"WITH {DIMS} SELECT round(quantile_cont(x, 0.95), 6) AS upper FROM d")
def q93_pooled_cut(spark, sf_dir):
    return features.pooled_cut(_dims(spark, sf_dir), "x", 95.0).select(r6("upper", "upper"))


@query(f"""WITH {EV}, m AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY k) AS d FROM ev)
SELECT event_id, coalesce(abs(d) > 0.01, false) AS moving, coalesce(d > 0, false) AS left FROM m""".replace("AS left", 'AS "left"'))
def q94_splits(spark, sf_dir):
    rows = ser.difference(series(spark, sf_dir), ["user_id"], "k", "value", "d_phi").withColumn("d_dist", F.abs("d_phi"))
    return rows.select("event_id", *[c.alias(k) for k, c in features.splits(rows).items()])


