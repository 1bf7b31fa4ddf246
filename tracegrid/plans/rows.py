"""Queries of trials, grids, flags and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.operators import drivers, trials
from tracegrid.plans.blocks import clock, seen
from tracegrid.plans.registry import DAY, EV, events, query, r6, series, table
from tracegrid.plans.scenes import VIEW
from tracegrid.sources import objects


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, CAST(o_orderdate::DATE AS VARCHAR) AS d FROM orders WHERE o_orderstatus <> 'F'")
def q140_present_values(spark, sf_dir):
    """Of each customer's orders the dates that are open, numbered; the others count as missing."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate").cast("date").cast("string")).alias("d"))
    return objects.present(rows, ["o_custkey"], "o_orderkey", "d", 100_000.0)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS row FROM supplier WHERE s_nationkey = 7")
def q141_catalogue(spark, sf_dir):
    return objects.catalogue(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), s_nationkey=7).select("s_suppkey", "row")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey < 40)")
def q142_of_kinds(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return trials.of_kinds(orders, "o_orderpriority", orders.where("o_orderkey < 40").select("o_orderpriority")).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS at, CAST(l_orderkey AS BIGINT) AS trial, CAST(l_linenumber AS BIGINT) AS rel FROM lineitem")
def q143_unrolled(spark, sf_dir):
    """Lines of orders as places in one long row, and back."""
    rows = trials.unrolled(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", "l_orderkey", 8)
    return trials.rolled(rows, "at", 8)


@query("SELECT CAST(p_partkey // 25 AS BIGINT) AS x, CAST(p_partkey % 25 AS BIGINT) AS z, p_retailprice FROM part")
def q144_surface(spark, sf_dir):
    return trials.surface(table(spark, sf_dir, "part"), "p_partkey", 25, "p_retailprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 5 = 2")
def q145_in_chunk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"chunk_x": F.col("l_linenumber"), "chunk_z": F.col("l_suppkey") % 5})
    return trials.in_chunk(rows, 1, 2).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, event_type = 'click' AS shown FROM events")
def q146_shown(spark, sf_dir):
    """The first entry of a stimulus list as a flag; an absent list shows nothing."""
    kind = F.col("event_type")
    stimuli = F.when(kind == "click", F.array(F.lit(1), F.lit(0))).when(kind == "view", F.array(F.lit(0), F.lit(1)))
    return events(spark, sf_dir).select("event_id", drivers.first_flag(stimuli).alias("shown"))


@query(f"""WITH {VIEW}, b AS (SELECT f.event_id, t, coalesce(bool_or(dist < 6), false) AS near FROM f LEFT JOIN w USING (event_id) GROUP BY 1, 2), c AS (SELECT DISTINCT t AS tau FROM ev WHERE event_type = 'signup'),
pr AS (SELECT c.tau, b.* FROM c ASOF LEFT JOIN b ON c.tau >= b.t), nx AS (SELECT c.tau, b.* FROM c ASOF LEFT JOIN b ON c.tau <= b.t)
SELECT round(pr.tau, 6) AS "at" FROM pr JOIN nx USING (tau) WHERE CASE WHEN pr.t IS NULL THEN nx.near WHEN nx.t IS NULL OR pr.tau - pr.t <= nx.t - pr.tau THEN pr.near ELSE nx.near END""")
def q147_near_something(spark, sf_dir):
    """Times of the other clock when something stood near."""
    beh, shown = seen(spark, sf_dir)
    return trials.near_something(shown, beh, clock(spark, sf_dir), [], "pos", "t", "at", 6.0, DAY).select(r6("at", "at"))


@query("""WITH g AS (SELECT o_orderpriority AS p, o_custkey % 5 AS iz, o_orderkey % 3 AS ix, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)
SELECT p, arg_min(iz, {'v': v, 'z': iz, 'x': ix}) AS iz, arg_min(ix, {'v': v, 'z': iz, 'x': ix}) AS ix FROM g GROUP BY p""")
def q148_least_place(spark, sf_dir):
    grid = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 5).alias("iz"), (F.col("o_orderkey") % 3).alias("ix")).agg(F.avg("o_totalprice").alias("v"))
    return trials.least_place(grid, ["p"], F.col("v"))


@query(f"""WITH {EV}, c AS (SELECT user_id, min(k) AS a, count(*) AS n FROM ev WHERE event_type <> 'error' GROUP BY 1),
x AS (SELECT user_id, k, value FROM ev WHERE k < 12 AND value IS NOT NULL), f AS (SELECT user_id, f FROM (SELECT DISTINCT user_id FROM ev), (SELECT unnest(range(0, 20)) AS f)),
m AS (SELECT user_id, f, CASE WHEN f BETWEEN 2 AND 7 THEN f - 2 WHEN f BETWEEN 14 AND 19 THEN f - 8 END AS k FROM f) SELECT user_id, f AS frame, round(coalesce(value, 0), 6) AS value FROM m LEFT JOIN x USING (user_id, k)""")
def q149_scattered(spark, sf_dir):
    """Each user's first values as two cuts of a timeline, with 0 in the gaps."""
    rows = series(spark, sf_dir).where("k < 12").select("user_id", "k", F.col("value").cast("double").alias("value"))
    cuts = series(spark, sf_dir).select("user_id").distinct().withColumn("c", F.explode(F.array(F.struct(F.lit(3).alias("start"), F.lit(8).alias("end")), F.struct(F.lit(15).alias("start"), F.lit(20).alias("end"))))).select("user_id", "c.*")
    return objects.scattered(rows, cuts, ["user_id"], "k", "value").select("user_id", F.col("frame").cast("bigint").alias("frame"), r6("value", "value"))
