"""Queries of group statistics over the fixture tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracegrid.operators import responses, stats
from tracegrid.operators.decoding import circular, drawn_shifts
from tracegrid.operators.ordered import positions
from tracegrid.plans.registry import query, r6, table

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("""WITH s AS (SELECT l_suppkey, avg(l_quantity) AS aq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS ap, stddev_pop(l_extendedprice) AS sp FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - aq) / CASE WHEN sq = 0 THEN 1 ELSE sq END, 5) AS zq, round((l_extendedprice - ap) / CASE WHEN sp = 0 THEN 1 ELSE sp END, 5) AS zp FROM lineitem JOIN s USING (l_suppkey)""")
def q17_zscore_guarded(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("zq"), F.col("l_extendedprice").alias("zp"))
    return stats.zscored(rows, ["l_suppkey"], ["zq", "zp"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("zq", 5).alias("zq"), F.round("zp", 5).alias("zp"))


MODES = {"mean_std": "coalesce((x - a) / nullif(s, 0), 0)", "mean": "coalesce(x / nullif(a, 0), 0)", "std": "coalesce(x / nullif(s, 0), 0)", "rms": "coalesce(x / nullif(r, 0), 0)", "none": "x"}


@query("WITH s AS (SELECT l_suppkey, avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, sqrt(avg(l_quantity * l_quantity)) AS r FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round({e.replace('x', 'l_quantity')}, 5) AS {m}" for m, e in MODES.items()) + " FROM lineitem JOIN s USING (l_suppkey)")
def q18_row_norm_modes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"))
    for mode in MODES:
        rows = stats.row_normalised(rows, ["l_suppkey"], "x", mode, mode)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(m, 5).alias(m) for m in MODES])


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1)
SELECT event_type, round(CASE WHEN min(value) < 0 THEN m - 2.5 * sqrt(sum((value - m) ** 2) / (count(*) - 1)) END, 6) AS lower, round(m + 2.5 * sqrt(sum((value - m) ** 2) / (count(*) - 1)), 6) AS upper FROM events JOIN m USING (event_type) GROUP BY event_type, m""")
def q19_signal_z_threshold(spark, sf_dir):
    out = stats.robust_threshold(table(spark, sf_dir, "events"), ["event_type"], "value", 2.5)
    return out.select("event_type", r6("lower", "lower"), r6("upper", "upper"))


DIMS = "d AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _dims(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).select("vec_id", "label", F.col("dim").cast("bigint").alias("dim"), F.col("x").cast("double").alias("x"))


@query(f"""WITH {DIMS}, m AS (SELECT dim, median(x) AS m FROM d GROUP BY dim), b AS (SELECT dim, m - 2 * sqrt(sum((x - m) ** 2) / (count(*) - 1)) AS lo, m + 2 * sqrt(sum((x - m) ** 2) / (count(*) - 1)) AS hi FROM d JOIN m USING (dim) GROUP BY dim, m),
f AS (SELECT vec_id, max(dim) AS ens FROM d JOIN b USING (dim) WHERE x > hi OR x < lo GROUP BY vec_id)
SELECT vec_id, ens FROM embeddings LEFT JOIN f USING (vec_id)""")
def q20_membership_complement(spark, sf_dir):
    from tracegrid.operators import ensembles

    rows = _dims(spark, sf_dir)
    found = ensembles.members(rows, "dim", "vec_id", "x", stats.robust_threshold(rows, ["dim"], "x", 2.0))
    return ensembles.last_wins(found, "dim", "vec_id").withColumnRenamed("dim", "ens").unionByName(ensembles.left_over(rows, found, "vec_id").withColumn("ens", F.lit(None).cast("bigint")))


@query(f"WITH {DIMS} SELECT vec_id, round(coalesce((sqrt(count(*)) - sum(abs(x)) / nullif(sqrt(sum(x * x)), 0)) / (sqrt(count(*)) - 1), 0), 6) AS sparsity FROM d GROUP BY vec_id")
def q21_hoyer(spark, sf_dir):
    return stats.hoyer(_dims(spark, sf_dir), ["vec_id"], "x").select("vec_id", r6("sparsity", "sparsity"))


@query(f"WITH {DIMS}, m AS (SELECT dim, max(abs(x)) AS m FROM d GROUP BY dim) SELECT dim, round(avg((abs(x) > 0.1 * m)::INT), 6) AS active FROM d JOIN m USING (dim) GROUP BY dim")
def q22_activation_fraction(spark, sf_dir):
    return stats.activation(_dims(spark, sf_dir), ["dim"], "x").select("dim", r6("active", "active"))


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events), n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT event_type, d, avg(CASE WHEN (k + 37 * (d + 1)) % n < n / 2 THEN value END) AS m FROM s JOIN n USING (event_type), (SELECT unnest(range(0, 20)) AS d) GROUP BY ALL),
e AS (SELECT event_type, avg(CASE WHEN k < n / 2 THEN value END) AS real FROM s JOIN n USING (event_type) GROUP BY 1)
SELECT event_type, round(real, 6) AS real, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round((1 + count(*) FILTER (m >= real)) / (count(*) + 1), 6) AS p FROM r JOIN e USING (event_type) GROUP BY event_type, real""")
def q24_null_band_pvalue(spark, sf_dir):
    rows = positions(table(spark, sf_dir, "events").select("event_type", "value", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), ["event_type"], "us", ["event_id"], "k", 86_400e6)
    rows = rows.join(rows.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")
    first = lambda k: F.avg(F.when(k < F.col("n") / 2, F.col("value")))
    real = rows.groupBy("event_type").agg(first(F.col("k")).alias("m"))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19))))
    nulls = drawn.groupBy("event_type", "draw").agg(first(F.pmod(F.col("k") + 37 * (F.col("draw") + 1), F.col("n"))).alias("m"))
    # Twenty draws a type, so a plain percentile holds few values.
    band = nulls.groupBy("event_type").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("b"))
    out = real.withColumnRenamed("m", "real").join(band, "event_type").join(stats.empirical_p(nulls, real, ["event_type"], "m"), "event_type")
    return out.select("event_type", r6("real", "real"), r6(F.col("b")[0], "low"), r6(F.col("b")[1], "high"), r6("p", "p"))


@query("""WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC) AS r FROM lineitem)
SELECT l_returnflag, l_linestatus, round(avg(x) FILTER (r <= 3), 6) AS top, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS q2, round(quantile_cont(x, 0.75), 6) AS q3 FROM r GROUP BY 1, 2""")
def q25_top3_quartiles(spark, sf_dir):
    rows, by = table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]
    q = stats.quantiles(rows, by, "l_extendedprice", [0.25, 0.5, 0.75])
    q = q.groupBy(*by).agg(*[r6(F.max(F.when(F.col("p") == p, F.col("q"))), f"q{i}") for i, p in enumerate((0.25, 0.5, 0.75), 1)])
    top = stats.top_mean(rows, by, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"]).withColumn("top", F.round("top", 6))
    return top.join(q, by)


@query("""WITH g AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, round(m, 4) AS mean, round(s, 4) AS sd, m = (SELECT min(m) FROM g) AS best FROM g""")
def q26_best_grid_cell(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    best = g.agg(F.min("m").alias("__m"))  # a grid of settings, so a single value
    return g.join(F.broadcast(best)).select("o_orderpriority", "o_orderstatus", F.round("m", 4).alias("mean"), F.round("s", 4).alias("sd"), (F.col("m") == F.col("__m")).alias("best"))


@query("""WITH h AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT event_type, sum(n * cos(-2 * pi() * h / 24)) AS re, sum(n * sin(-2 * pi() * h / 24)) AS im FROM h GROUP BY 1)
SELECT event_type, round(sqrt(re * re + im * im), 5) AS amplitude, round(atan2(im, re), 5) AS phase FROM c""")
def q44_dft_bin(spark, sf_dir):
    profile = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count("*").alias("n")).withColumn("len", F.lit(24))
    return responses.fourier(profile, ["event_type"], "h", "n", "len").select("event_type", F.round("amplitude", 5).alias("amplitude"), F.round("phase", 5).alias("phase"))


@query("""WITH a AS (SELECT l_returnflag, l_extendedprice AS p, l_quantity AS q, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS rp,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rq FROM lineitem),
m AS (SELECT l_returnflag, avg(p) AS m, stddev_pop(p) AS s FROM a GROUP BY 1)
SELECT l_returnflag, round(regr_slope(p, q), 4) AS slope, round(corr(rp, rq), 6) AS rho, round(avg(((p - m) / s) ** 3), 5) AS skew FROM a JOIN m USING (l_returnflag) GROUP BY 1""")
def q45_regr_spearman(spark, sf_dir):
    rows, by = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), ["l_returnflag"]
    fit = rows.groupBy(*by).agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.skewness("l_extendedprice"), 5).alias("skew"))
    return fit.join(stats.spearman(rows, by, "l_extendedprice", "l_quantity").withColumn("rho", F.round("rho", 6)), by)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q46_json_config(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT round(avg((label = 0)::INT), 6) AS share, round((sum(CASE WHEN label = 0 THEN r END) - count(*) FILTER (label = 0) * (count(*) FILTER (label = 0) + 1) / 2) / (count(*) FILTER (label = 0) * count(*) FILTER (label <> 0)), 6) AS auc
FROM (SELECT label, rank() OVER (ORDER BY embedding[1]) + (count(*) OVER (PARTITION BY embedding[1]) - 1) / 2 AS r FROM embeddings)""")
def q40_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].alias("x"), F.lit(1).alias("g"))
    found = stats.auc(rows, ["g"], F.col("label") == 0, "x").join(rows.groupBy("g").agg(F.avg((F.col("label") == 0).cast("double")).alias("share")), "g")
    return found.select(r6("share", "share"), r6("auc", "auc"))


def q48_stim_tuning(spark, sf_dir):
    """Users whose purchases have a mean value above what resampling of all their events gives. Draws are hashed, so SQL has none."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = positions(ev, ["user_id"], "us", ["event_id"], "k", 86_400e6)
    out = responses.tuned(rows, ["user_id", "event_type"], "k", "value", 200, 95.0)
    return out.select("user_id", "event_type", r6("response", "response"), r6("cut", "cut"), "tuned")


query()(q48_stim_tuning)


def q53_shuffled_series(spark, sf_dir):
    """Means of each user's first half after circular shifts drawn by hash."""
    ev = table(spark, sf_dir, "events").select("user_id", "value", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = positions(ev, ["user_id"], "us", ["event_id"], "k", 86_400e6).select("user_id", "k", "value")
    sizes = ev.groupBy("user_id").agg(F.count("*").alias("n"))
    out = circular(rows.join(sizes, "user_id"), drawn_shifts(sizes, "user_id", 3, "n", 2), "user_id", "k", "n")
    return out.groupBy("draw", "user_id").agg(r6(F.avg(F.when(2 * F.col("k") < F.col("n"), F.col("value"))), "mean"))


query()(q53_shuffled_series)

HALF_TURN = math.pi
