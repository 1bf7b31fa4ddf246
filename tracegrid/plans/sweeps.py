"""Queries of factors, clusters of cells and sweeps of decoders, over embeddings and counts of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.operators import clustering, drivers, ensembles, factors, linalg, sweeps
from tracegrid.operators.settle import settled
from tracegrid.plans.models import vectors
from tracegrid.plans.registry import events, query, r6, table

KINDS = [f"{k}-{d}" for k in ("click", "error", "purchase", "signup", "view") for d in range(1, 8)]


def counts(spark, sf_dir):
    """(cell, pos, value): events of each kind and weekday in each hour of the record."""
    ev = events(spark, sf_dir).where("t is not null").select(F.concat_ws("-", "event_type", F.dayofweek("ts")).alias("cell"), F.floor(F.col("t") / 3600).cast("bigint").alias("pos"))
    return settled(ev.groupBy("cell", "pos").agg(F.count("*").cast("double").alias("value")))


def filled(rows, cells):
    """The same with 0 for hours without an event, and the number of hours."""
    n = (rows.agg(F.max("pos")).collect()[0][0] or 0) + 1
    every = rows.sparkSession.createDataFrame([(c,) for c in cells], "cell string").withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return settled(every.join(rows, ["cell", "pos"], "left").na.fill(0.0, ["value"])), n


@query()
def q107_factor_losses(spark, sf_dir):
    """The three losses of non-negative factors, round by round."""
    rows = vectors(spark, sf_dir).withColumn("v", F.transform("v", F.abs))
    out = [(loss, k, round(x, 4)) for loss in factors.LOSSES for k, x in enumerate(factors.nmf(rows, "v", 4, loss, rounds=6, inner=20, tol=0.0).losses)]
    return spark.createDataFrame(out, "loss string, round int, value double")


@query()
def q108_sparse_components(spark, sf_dir):
    """Loadings of sparse components that are not 0."""
    h = factors.sparse_principal(vectors(spark, sf_dir), "v", 4, 0.02, rounds=100).h
    return spark.createDataFrame([(k, j, round(float(x), 5)) for k, row in enumerate(h) for j, x in enumerate(row) if x], "comp int, place int, loading double")


@query()
def q109_cv_components(spark, sf_dir):
    """Errors of components on hours left out, for each smoothing, number of components and fold."""
    rows, n = filled(counts(spark, sf_dir), KINDS)
    found = factors.cross_validated(rows, "cell", "pos", "value", KINDS, n, [0.0, 2.0], [1, 2, 4], 5)
    return spark.createDataFrame([(r["sigma"], r["k"], r["fold"], *(round(r[c], 5) for c in ("train_err_sm", "test_err", "test_err_sm", "test_norm"))) for r in found], "sigma double, k int, fold int, train_err_sm double, test_err double, test_err_sm double, test_norm double")


@query("""WITH d AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT k, avg(x) AS m FROM d GROUP BY k),
p AS (SELECT x AS a, CASE WHEN k <= 32 THEN x ELSE m END AS b FROM d JOIN m USING (k))
SELECT round(sqrt(sum(a * a)), 5) AS frob_data, round(sqrt(sum(b * b)), 5) AS frob_rec, round(sqrt(sum((a - b) ** 2)), 5) AS frob_error, round(sqrt(sum((a - b) ** 2)) / sqrt(sum(a * a)), 5) AS rel_error, round(sum((a - b) ** 2), 4) AS ss_res, round(var_pop(a) * count(a), 4) AS ss_tot, round(1 - sum((a - b) ** 2) / (var_pop(a) * count(a)), 5) AS explained_var,
round(sum(greatest(a, 1e-10) * ln(greatest(a, 1e-10) / greatest(b, 1e-10)) - greatest(a, 1e-10) + greatest(b, 1e-10)), 3) AS kl FROM p""")
def q110_reconstruction(spark, sf_dir):
    """What is missed when the second half of each vector is its mean."""
    rows = vectors(spark, sf_dir)
    mean = F.array(*[F.lit(float(x)) for x in linalg.moments(rows, "v")[None].mean])
    made = rows.withColumn("made", F.zip_with(F.transform("v", lambda x, i: F.when(i < 32, x)), mean, lambda x, m: F.coalesce(x, m)))
    return factors.errors(made, "v", "made").select(*[F.round(c, d).alias(c) for c, d in (("frob_data", 5), ("frob_rec", 5), ("frob_error", 5), ("rel_error", 5), ("ss_res", 4), ("ss_tot", 4), ("explained_var", 5), ("kl", 3))])


@query()
def q111_cell_clusters(spark, sf_dir):
    """Cells in groups by correlation over hours, and their order along the tree."""
    rows = ensembles.to_vectors(counts(spark, sf_dir), "pos", "cell", "value", KINDS)
    labels, order = clustering.clustered(rows, "v", 6, "average", "correlation")
    return spark.createDataFrame([(KINDS[c], int(labels[c]), order.index(c)) for c in range(len(labels))], "cell string, cluster int, leaf int")


@query()
def q112_cluster_extract(spark, sf_dir):
    """Cells that go together more than by chance, grouped by their loadings; 0 for the others."""
    rows, n = filled(counts(spark, sf_dir), KINDS)
    wide = settled(ensembles.to_vectors(rows, "pos", "cell", "value", KINDS))
    found = linalg.principal(wide, "v", 3)
    loads = spark.createDataFrame([(c, j, float(found.loadings[c, j])) for c in range(len(found.loadings)) for j in range(len(KINDS))], "comp bigint, cell bigint, value double")
    scores = linalg.scores(wide, "v", found, ["pos"], 3).select("pos", F.posexplode("scores").alias("comp", "value"))
    null = [ensembles.to_vectors(rows.withColumn("pos", F.pmod(F.col("pos") + F.pmod(F.xxhash64(F.lit(d), "cell"), F.lit(n)), F.lit(n))), "pos", "cell", "value", KINDS) for d in range(3)]
    cells, active = clustering.extract_clusters(wide, null, "v", loads, scores, 4, "pos", 90.0)
    hours = active.groupBy("cluster").agg(F.count_if("active").alias("hours"))
    return cells.join(hours, "cluster", "left").select("cell", F.col("cluster").cast("int").alias("cluster"), F.coalesce("hours", F.lit(0)).alias("hours"))


def targets(spark, sf_dir):
    """Vectors with targets: the label, one of the places plus the label, and a line in the position."""
    rows = vectors(spark, sf_dir)
    return settled(rows.select("pos", "v", F.col("y").alias("label"), (F.get("v", 3) + F.col("y") / 10).alias("mixed"), (F.get("v", 0) + F.col("pos") / 1000).alias("drift")))


NAMES = ["label", "mixed", "drift"]


@query()
def q113_component_sweep(spark, sf_dir):
    """R2 of ridge models on the first k components, for each target, embargo and fold, from one pass."""
    rows = targets(spark, sf_dir)
    scored = linalg.scores(rows, "v", linalg.principal(rows, "v", 32), ["pos", *NAMES], 32)
    out = sweeps.ridge_sweep(scored, "scores", NAMES, "pos", rows.count(), [1, 2, 4, 8, 16, 32], 5, [0, 10])
    return out.select("target", "k", "embargo", "fold", r6("r2", "r2"))


T = "t AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n, embedding[1]::DOUBLE AS x, label::DOUBLE AS label, embedding[4]::DOUBLE + label / 10.0 AS mixed FROM embeddings), l AS (SELECT pos, n, x, unnest(['label', 'mixed']) AS target, unnest([label, mixed]) AS y FROM t), f AS (SELECT *, least(pos // (n // 5), 4) AS fold FROM l)"


@query(f"""WITH {T}, e AS (SELECT DISTINCT fold AS g, min(pos) OVER (PARTITION BY fold) AS lo, max(pos) OVER (PARTITION BY fold) AS hi FROM f), b AS (SELECT unnest([0, 10]) AS embargo),
m AS (SELECT target, embargo, g, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM f, e, b WHERE pos < lo - embargo OR pos > hi + embargo GROUP BY ALL)
SELECT target, CAST(embargo AS INT) AS embargo, CAST(fold AS INT) AS fold, round(1 - sum((y - s * x - i) ** 2) / (count(*) * var_pop(y)), 5) AS r2 FROM f JOIN m USING (target) WHERE g = fold GROUP BY ALL""")
def q114_line_sweep(spark, sf_dir):
    """The sweep with one place and no penalty."""
    rows = targets(spark, sf_dir)
    out = sweeps.ridge_sweep(rows, "v", ["label", "mixed"], "pos", rows.count(), [1], 5, [0, 10], 0.0)
    return out.select("target", "embargo", "fold", F.round("r2", 5).alias("r2"))


@query(f"""WITH {T}, e AS (SELECT DISTINCT fold AS g, min(pos) OVER (PARTITION BY fold) AS lo, max(pos) OVER (PARTITION BY fold) AS hi FROM f),
m AS (SELECT target, g, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM f, e WHERE pos < lo OR pos > hi GROUP BY ALL),
r AS (SELECT target, fold, 1 - sum((y - s * x - i) ** 2) / (count(*) * var_pop(y)) AS r2 FROM f JOIN m USING (target) WHERE g = fold GROUP BY ALL)
SELECT 'first' AS embedding, target, round(avg(r2), 5) AS mean, round(stddev_pop(r2), 5) AS std, count(*) AS n FROM r GROUP BY target""")
def q115_decoding_table(spark, sf_dir):
    rows = targets(spark, sf_dir).withColumn("first", F.slice("v", 1, 1))
    out = sweeps.decoding_table(rows, {"first": "first"}, ["label", "mixed"], "pos", rows.count(), alpha=0.0)
    return out.select("embedding", "target", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n")


@query()
def q116_null_sweep(spark, sf_dir):
    """The sweep of real targets beside targets moved round."""
    rows = targets(spark, sf_dir)
    return sweeps.null_sweep(rows, "v", NAMES, "pos", rows.count(), [2, 8, 32], 4).select("target", "k", "fold", "draw", r6("r2", "r2"))


@query()
def q117_detrend_grid(spark, sf_dir):
    rows = targets(spark, sf_dir)
    out = sweeps.detrend_grid(rows, "v", ["mixed", "drift"], "pos", rows.count(), 8, [0.0, 20.0, 50.0], [0, 10], 5)
    return out.select("target", "sigma", "embargo", *[r6(c, c) for c in ("r2", "null", "delta", "p")])


@query()
def q118_logistic_folds(spark, sf_dir):
    """Area under the curve of logistic models in blocked folds, for two questions about the label."""
    rows = targets(spark, sf_dir).selectExpr("pos", "v", "double(label = 0) as zero", "double(label > 4) as high")
    return sweeps.logistic_auc(rows, "v", ["zero", "high"], "pos", rows.count(), 5, 10).select("target", "fold", r6("auc", "auc"))


@query()
def q119_decoders(spark, sf_dir):
    """R2 over all folds' predictions together, by each kind of decoder."""
    from tracegrid.operators import decoding

    rows, out = targets(spark, sf_dir).withColumn("v", F.slice("v", 1, 8)), None
    n = rows.count()
    for name in ("ridge", "ridgecv", "knn", "pls", "cca"):
        fit = decoding.pooled_fit(sweeps.decoder(name)(rows, "v", ["mixed"], "pos", n, 5, 5), "mixed")
        one = fit.select(F.lit(name).alias("decoder"), *[F.round(c, 5).alias(c) for c in ("slope", "intercept", "r2")])
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH t AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, embedding[1]::DOUBLE AS x, embedding[4]::DOUBLE + label / 10.0 AS y FROM embeddings), m AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM t) SELECT pos, round(s * x + i, 6) AS pred FROM t, m")
def q120_in_sample(spark, sf_dir):
    rows = targets(spark, sf_dir).withColumn("v", F.slice("v", 1, 1))
    return sweeps.in_sample(rows, "v", ["mixed"], "pos", 0.0).select("pos", r6("pred_mixed", "pred"))


@query()
def q121_variance_curve(spark, sf_dir):
    """Shares of variance beside those of data whose places are moved round."""
    rows = vectors(spark, sf_dir)
    return sweeps.variance_curve(rows, "v", "pos", rows.count(), 3).select("comp", *[r6(c, c) for c in ("ratio", "cumulative", "null_low", "null_high")])


@query()
def q122_shuffled_thresholds(spark, sf_dir):
    rows, n = filled(counts(spark, sf_dir), KINDS)
    out = drivers.shuffled_thresholds(rows, "cell", "pos", "value", KINDS, n, 2, 5, 95.0, "pca")
    return out.select("of", r6("low", "low"), r6("high", "high"))


@query()
def q123_elastic_net(spark, sf_dir):
    """The penalised loss of the factors, round by round."""
    fit = factors.elastic_net(vectors(spark, sf_dir), "v", 3, 0.5, 0.5, 6)
    return spark.createDataFrame([(k, round(x, 4)) for k, x in enumerate(fit.losses)], "round int, value double")


@query()
def q124_trial_components(spark, sf_dir):
    """Share of variance of components of the vectors in windows about every hundredth one."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("v"))
    found, _ = drivers.trial_components(rows, rows.where("pos % 100 = 50").select("pos"), [], "pos", "v", 5, 5, 5)
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(found.ratios[:5])], "comp int, ratio double")
