"""Linear models at a width where their normal equations and eigenvalues can be stated in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.operators import decoding, linalg
from tracegrid.plans.models import vectors
from tracegrid.plans.registry import query, r6

V = "v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n, CAST(embedding AS DOUBLE[]) AS e, label::DOUBLE AS label FROM embeddings)"


@query(f"""WITH {V}, t AS (SELECT pos, e[1] AS x, e[5] AS b FROM v), m AS (SELECT covar_pop(x, b) * count(*) / (var_pop(b) * count(*) + 1e-3) AS w, avg(x) AS mx, avg(b) AS mb FROM t)
SELECT pos, round(x - mx - w * (b - mb), 6) AS rest FROM t, m""")
def q150_residual_line(spark, sf_dir):
    """What a place of each vector has beyond a ridge model on another place."""
    rows = vectors(spark, sf_dir).select("pos", F.slice("v", 1, 1).alias("x"), F.slice("v", 5, 1).alias("b"))
    return linalg.residual(rows, "x", "b", ["pos"]).select("pos", F.round(F.get("vector", F.lit(0)), 6).alias("rest"))


STARTS = (1, 5, 9)


@query(f"""WITH {V}, t AS (SELECT unnest([{', '.join(map(str, STARTS))}]) AS start, e FROM v), p AS (SELECT start, e[start] AS a, e[start + 1] AS b, e[start + 2] + e[start] AS c, e[start + 3] - e[start + 1] AS d FROM t),
m AS (SELECT start, covar_pop(a, c) AS ac, covar_pop(a, d) AS ad, covar_pop(b, c) AS bc, covar_pop(b, d) AS bd, (var_pop(a) + var_pop(b)) * (var_pop(c) + var_pop(d)) AS s FROM p GROUP BY start)
SELECT CAST(start AS INT) AS start, round(1 - (ac * ac + ad * ad + bc * bc + bd * bd + 2 * abs(ac * bd - ad * bc)) / s, 6) AS disparity FROM m""")
def q151_procrustes_plane(spark, sf_dir):
    """Disparity of two planes of the vectors, for three choices of places."""
    rows, out = vectors(spark, sf_dir), []
    for s in STARTS:
        at = lambda k, s=s: F.get("v", F.lit(s - 1 + k))
        pair = rows.select(F.array(at(0), at(1)).alias("a"), F.array(at(2) + at(0), at(3) - at(1)).alias("b"))
        out.append((s, round(linalg.procrustes(pair, "a", "b"), 6)))
    return spark.createDataFrame(out, "start int, disparity double")


PLANE = f"{V}, t AS (SELECT pos, e[1] AS x, e[2] + e[1] / 2 AS y FROM v), m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM t), g AS (SELECT *, sqrt((a - c) ** 2 / 4 + b * b) AS gap, atan2(2 * b, a - c) / 2 AS turn FROM m)"


def plane(spark, sf_dir):
    x, y = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    return vectors(spark, sf_dir).select("pos", F.array(x, y + x / 2).alias("v"))


@query(f"WITH {PLANE} SELECT 0::BIGINT AS comp, round(((a + c) / 2 + gap) / (a + c), 6) AS ratio FROM g UNION ALL SELECT 1, round(((a + c) / 2 - gap) / (a + c), 6) FROM g")
def q152_plane_variance(spark, sf_dir):
    """Shares of variance of the two components of a plane."""
    ratios = linalg.principal(plane(spark, sf_dir), "v").ratios
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(ratios)], "comp bigint, ratio double")


@query(f"""WITH {PLANE}, u AS (SELECT *, CASE WHEN abs(cos(turn)) >= abs(sin(turn)) THEN sign(cos(turn)) ELSE sign(sin(turn)) END AS s FROM g)
SELECT pos, round(s * ((x - mx) * cos(turn) + (y - my) * sin(turn)), 6) AS score, round(((y - my) * cos(turn) - (x - mx) * sin(turn)) ** 2, 6) AS rest FROM t, u""")
def q153_plane_scores(spark, sf_dir):
    """Each row's score on the first component, and its squared distance from what that alone gives back."""
    rows = plane(spark, sf_dir)
    found = linalg.principal(rows, "v")
    scored = linalg.scores(rows, "v", found, ["pos"], 1)
    back = linalg.rebuilt(scored, "scores", found, ["pos"], 1).join(rows, "pos").join(scored, "pos")
    rest = F.aggregate(F.zip_with("v", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return back.select("pos", F.round(F.get("scores", F.lit(0)), 6).alias("score"), r6(rest, "rest"))


@query(f"""WITH {V}, t AS (SELECT pos, n, e[1] AS x, e[4] + label / 10 AS y, least(pos // (n // 5), 4) AS fold FROM v), f AS (SELECT fold AS g, min(pos) AS lo, max(pos) AS hi FROM t GROUP BY fold),
m AS (SELECT g, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) / (var_pop(x) * (count(*) + 1)) AS w FROM t, f WHERE pos < lo - 10 OR pos > hi + 10 GROUP BY g)
SELECT pos, fold::BIGINT AS fold, round(my + w * (x - mx), 6) AS pred FROM t JOIN m ON g = fold""")
def q154_ridge_line(spark, sf_dir):
    """Predictions of ridge models in blocked folds with an embargo, from one place."""
    rows = vectors(spark, sf_dir).select("pos", F.slice("v", 1, 1).alias("v"), (F.get("v", F.lit(3)) + F.col("y") / 10).alias("mixed"))
    return decoding.ridge_oof(rows, "v", ["mixed"], "pos", rows.count(), 5, 10, 1.0).select("pos", "fold", r6("pred_mixed", "pred"))


@query(f"""WITH RECURSIVE {V}, t AS (SELECT 4 * e[1] + label / 5 AS x, CASE WHEN label > 4 THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM v),
b AS (SELECT 0 AS step, 0.0::DOUBLE AS w, 0.0::DOUBLE AS i UNION ALL
SELECT step + 1, w - (hii * gw - hwi * gi) / (hww * hii - hwi * hwi), i - (hww * gi - hwi * gw) / (hww * hii - hwi * hwi) FROM (
SELECT step, w, i, sum(x * (p - y)) + w AS gw, sum(p - y) AS gi, sum(p * (1 - p) * x * x) + 1 AS hww, sum(p * (1 - p) * x) AS hwi, sum(p * (1 - p)) AS hii
FROM (SELECT step, w, i, x, y, 1 / (1 + exp(-(w * x + i))) AS p FROM b, t WHERE step < 12) GROUP BY step, w, i))
SELECT 0::BIGINT AS place, round(w, 6) AS weight FROM b WHERE step = 12 UNION ALL SELECT 1, round(i, 6) FROM b WHERE step = 12""")
def q155_logistic_line(spark, sf_dir):
    """Slope and intercept of a penalised logistic model of high labels on a mix of label and place."""
    rows = vectors(spark, sf_dir).select(F.array(4 * F.get("v", F.lit(0)) + F.col("y") / 5).alias("v"), (F.col("y") > 4).cast("double").alias("y"))
    return spark.createDataFrame([(k, round(float(b), 6)) for k, b in enumerate(decoding.logistic(rows, "v", "y"))], "place bigint, weight double")


@query(f"""WITH {V}, t AS (SELECT e[1] AS a, e[2] AS b, e[4] + e[1] AS c, e[5] - e[2] / 2 AS d FROM v),
m AS (SELECT var_pop(a) + 1e-9 AS aa, covar_pop(a, b) AS ab, var_pop(b) + 1e-9 AS bb, var_pop(c) + 1e-9 AS cc, covar_pop(c, d) AS cd, var_pop(d) + 1e-9 AS dd, covar_pop(a, c) AS ac, covar_pop(a, d) AS ad, covar_pop(b, c) AS bc, covar_pop(b, d) AS bd FROM t),
k AS (SELECT *, aa * bb - ab * ab AS dx, cc * dd - cd * cd AS dy FROM m),
q AS (SELECT (ac * bd - ad * bc) ** 2 / (dx * dy) AS det, (bb * (ac * ac * dd - 2 * ac * ad * cd + ad * ad * cc) - 2 * ab * (ac * bc * dd - (ac * bd + ad * bc) * cd + ad * bd * cc) + aa * (bc * bc * dd - 2 * bc * bd * cd + bd * bd * cc)) / (dx * dy) AS tr FROM k)
SELECT 0::BIGINT AS pair, round(sqrt((tr + sqrt(tr * tr - 4 * det)) / 2), 6) AS r FROM q UNION ALL SELECT 1, round(sqrt((tr - sqrt(tr * tr - 4 * det)) / 2), 6) FROM q""")
def q156_canonical_plane(spark, sf_dir):
    """Canonical correlations of two planes."""
    at = lambda k: F.get("v", F.lit(k))
    rows = vectors(spark, sf_dir).select(F.array(at(0), at(1)).alias("x"), F.array(at(3) + at(0), at(4) - at(1) / 2).alias("y"))
    return spark.createDataFrame([(k, round(float(r), 6)) for k, r in enumerate(linalg.canonical(rows, "x", "y", 2)[0])], "pair bigint, r double")


@query(f"""WITH {V}, d AS (SELECT pos, unnest(range(0, 8)) AS k, unnest(e[1:8]) AS x, e[4] + label / 10 AS y FROM v), r AS (SELECT k, corr(x, y) AS r FROM d GROUP BY k), s AS (SELECT sqrt(sum(r * r)) AS s FROM r),
w AS (SELECT k, r / s AS w FROM r, s), c AS (SELECT a.k AS i, b.k AS j, corr(a.x, b.x) AS c FROM d a JOIN d b USING (pos) GROUP BY ALL),
z AS (SELECT sum(c * a.w * b.w) AS z FROM c JOIN w a ON a.k = i JOIN w b ON b.k = j) SELECT k AS place, round(w * s / z, 6) AS coefficient FROM w, s, z""")
def q157_partial_least_squares(spark, sf_dir):
    """Coefficients of one component of partial least squares, places and target in units of their deviation."""
    rows = vectors(spark, sf_dir).select(F.concat(F.slice("v", 1, 8), F.array(F.get("v", F.lit(3)) + F.col("y") / 10)).alias("v"))
    w = linalg.partial_least_squares(linalg.moments(rows, "v")[None], 8, 1)
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(w[:, 0])], "place bigint, coefficient double")
