"""Queries of linear models and factors over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.operators import decoding, ensembles, linalg
from tracegrid.operators.ordered import positions
from tracegrid.plans.registry import events, query, r6, table


def vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("y"))
    return positions(rows, [], "vec_id", [], "pos", 100_000.0)


@query("""WITH d AS (SELECT vec_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.dim AS i, b.dim AS j, round(corr(a.x, b.x), 5) AS r FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY ALL""")
def q36_gram_corr(spark, sf_dir):
    c = linalg.correlations(vectors(spark, sf_dir), "v")
    return spark.createDataFrame([(i, j, round(float(c[i, j]), 5)) for i in range(len(c)) for j in range(i + 1, len(c))], "i bigint, j bigint, r double")


@query()
def q37_pca_variance(spark, sf_dir):
    ratios = linalg.principal(vectors(spark, sf_dir), "v").ratios
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(ratios)], "comp bigint, ratio double")


@query()
def q38_ridge_oof(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    out = decoding.r2_by_fold(decoding.ridge_oof(rows, "v", ["y"], "pos", rows.count(), 5, 10, 1.0), "y")
    return out.select("fold", r6("r2", "r2"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings), f AS (SELECT *, least(pos // (n // 5), 4) AS fold FROM v),
b AS (SELECT fold, min(pos) AS lo, max(pos) AS hi FROM f GROUP BY fold), d AS (SELECT a.pos, t.label AS y, t.pos AS tp, list_distance(a.e, t.e) AS d FROM f a JOIN b USING (fold) JOIN f t ON t.pos < lo - 5 OR t.pos > hi + 5),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY d, tp) AS r FROM d)
SELECT pos, round(CASE WHEN min(d) = 0 THEN avg(CASE WHEN d = 0 THEN y END) ELSE sum(y / nullif(d, 0)) / sum(1 / nullif(d, 0)) END, 5) AS pred FROM r WHERE r <= 15 GROUP BY pos""")
def q39_knn_oof(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return decoding.knn_oof(rows, "v", "y", "pos", rows.count(), 5, 5).select("pos", F.round("pred", 5).alias("pred"))


@query()
def q42_recon_error(spark, sf_dir):
    """Squared error that is left after k components, summed over all rows."""
    rows = vectors(spark, sf_dir)
    found = linalg.principal(rows, "v")
    out = None
    for k in (2, 8, 32):
        back = linalg.rebuilt(linalg.scores(rows, "v", found, ["pos"]), "scores", found, ["pos"], k).join(rows, "pos")
        err = back.select(F.aggregate(F.zip_with("v", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b).alias("e"))
        one = err.agg(F.round(F.sum("e"), 4).alias("error")).select(F.lit(k).alias("k"), "error")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def q43_procrustes(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.slice("v", 1, 3).alias("a"), F.slice("v", 4, 3).alias("b"))
    return spark.createDataFrame([(round(linalg.procrustes(rows, "a", "b"), 6),)], "disparity double")


@query()
def q49_nmf_loss(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("v", F.transform("v", F.abs))
    _, errors = linalg.factorised(rows, "v", 4, 8)
    return spark.createDataFrame([(k, round(e, 4)) for k, e in enumerate(errors)], "round bigint, error double")


@query()
def q50_ensemble_extract(spark, sf_dir):
    """Ensembles among kinds of events by hour of day and weekday; the kind and weekday make a cell."""
    ev = events(spark, sf_dir).select(F.floor(F.col("t") / 3600).cast("bigint").alias("frame"), F.concat_ws("-", "event_type", F.dayofweek("ts")).alias("cell"))
    rows = ev.groupBy("frame", "cell").agg(F.count("*").cast("double").alias("value"))
    cells = [f"{k}-{d}" for k in ("click", "error", "purchase", "signup", "view") for d in range(1, 8)]
    who, _ = ensembles.extract(rows, "frame", "cell", "value", cells, 3, 0.0, 1.5, "none", 8)
    return who


@query()
def q56_logistic(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("y", (F.col("y") == 0).cast("double"))
    beta = decoding.logistic(rows, "v", "y", 1.0, 8)
    return spark.createDataFrame([(k, round(float(b), 6)) for k, b in enumerate(beta)], "place bigint, weight double")


@query()
def q57_residual(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("pos", F.slice("v", 1, 4).alias("x"), F.slice("v", 5, 4).alias("b"))
    return linalg.residual(rows, "x", "b", ["pos"]).select("pos", F.transform("vector", lambda x: F.round(x, 6)).alias("left"))
