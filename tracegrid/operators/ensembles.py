"""Groups of cells that are active together: thresholds on loadings and scores, membership, and the whole extraction.

Loadings are rows (comp, cell, value), scores rows (comp, frame, value).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.linalg import Components, factorised, mapped, mean_correlation, moments, row_weights
from tracegrid.operators.ordered import joined, ranked
from tracegrid.operators.series import smoothed
from tracegrid.operators.stats import robust_threshold, row_normalised


def members(values: DataFrame, comp: str, item: str, value: str, bounds: DataFrame) -> DataFrame:
    """(comp, item) of values over their component's upper bound or under its lower one."""
    met = joined(values, bounds, [comp], "inner")
    return met.where((F.col(value) > F.col("upper")) | (F.col(value) < F.col("lower"))).select(comp, item)


def last_wins(found: DataFrame, comp: str, item: str) -> DataFrame:
    """(item, comp): of the components that claim an item the greatest."""
    return found.groupBy(item).agg(F.max(comp).alias(comp))


def sizes(found: DataFrame, comps: DataFrame, comp: str, least: int = 2) -> DataFrame:
    """(comp, n, low): members of every component, and whether they are fewer than ``least``."""
    n = found.groupBy(comp).agg(F.count("*").alias("n"))
    return joined(comps.select(comp).distinct(), n, [comp]).na.fill(0, ["n"]).withColumn("low", F.col("n") < least)


def left_over(items: DataFrame, found: DataFrame, item: str) -> DataFrame:
    """Items in no component."""
    return items.select(item).distinct().join(found.select(item).distinct(), item, "left_anti")


def projected(loadings: DataFrame, scores: DataFrame, labels: DataFrame, comp: str, cell: str, frame: str, value: str, sigma: float = 3.0) -> DataFrame:
    """(cluster, frame, score, active): mean loading of a cluster's cells times the scores; active beyond sigma deviations from zero."""
    mean = loadings.join(labels, cell).groupBy("cluster", comp).agg(F.avg(value).alias("__w"))
    out = mean.join(scores, comp).groupBy("cluster", frame).agg(F.sum(F.col("__w") * F.col(value)).alias("score"))
    spread = out.groupBy("cluster").agg(F.stddev_pop("score").alias("__s"))
    return joined(out, spread, ["cluster"]).withColumn("active", F.abs("score") > sigma * F.col("__s")).drop("__s")


def to_vectors(df: DataFrame, frame: str, cell: str, value: str, cells: list) -> DataFrame:
    """(frame, v): the cells' values of each frame in a fixed order; absent ones are 0."""
    cols = [F.coalesce(F.max(F.when(F.col(cell) == c, F.col(value))), F.lit(0.0)) for c in cells]
    return df.groupBy(frame).agg(F.array(*cols).cast("array<double>").alias("v"))


def significant_components(values: DataFrame, vector: str, draws: int = 5, seed: int = 0, frame: str = "frame", n: int | None = None) -> float:
    """Mean number, over draws, of eigenvalues above the greatest of the same data with every place moved round by a shift of its own.

    All draws are put together in one shuffle, and measured in one pass.
    """
    n = n or values.count()
    whole = moments(values, vector)[None]
    real = np.linalg.eigvalsh(whole.scatter)
    if not len(real):
        return 0.0
    long = values.select(frame, F.posexplode(vector).alias("__c", "__x")).withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    moved = long.withColumn(frame, F.pmod(F.col(frame) + F.pmod(F.xxhash64(F.lit(seed), "__d", "__c"), F.lit(n)), F.lit(n)))
    wide = moved.groupBy("__d", frame).agg(F.transform(F.array_sort(F.collect_list(F.struct("__c", "__x"))), lambda s: s["__x"]).alias(vector))  # a place's value each
    null = moments(wide, vector, "__d", shift=whole.shift)
    return float(np.mean([(real > np.linalg.eigvalsh(m.scatter).max()).sum() for m in null.values()]))


def silent(df: DataFrame, cell: str, value: str) -> DataFrame:
    """Rows of cells whose sum is over 0."""
    return df.join(df.groupBy(cell).agg(F.sum(value).alias("__s")).where("__s > 0").select(cell), cell, "left_semi")


def extract(df: DataFrame, frame: str, cell: str, value: str, cells: list, k: int = 2, sigma: float = 0.0, z: float = 2.5, normalise: str = "rms", rounds: int = 15, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(comp, cell) and (comp, frame) of ensembles: drop silent cells, smooth, normalise, factorise, cut off.

    cells: the cells to look at, in order; their number is the width of the vectors and is meant to be some thousands.
    """
    rows = smoothed(silent(df, cell, value), [cell], frame, {value: value}, sigma)
    rows = row_normalised(rows, [cell], value, normalise)
    vectors = to_vectors(rows, frame, cell, value, cells)
    h, _ = factorised(vectors, "v", k, rounds, seed=seed)
    spark = df.sparkSession
    loads = spark.createDataFrame([(c, str(cells[j]), float(h[c, j])) for c in range(k) for j in range(len(cells))], "comp bigint, cell string, value double")
    scores = mapped(vectors, "v", {"s": "array<double>"}, lambda v, _: {"s": row_weights(np.maximum(v, 0), h)}, [frame]).select(frame, F.posexplode("s").alias("comp", "value")).withColumn("comp", F.col("comp").cast("bigint"))
    who = members(loads, "comp", "cell", "value", robust_threshold(loads, ["comp"], "value", z))
    when = members(scores, "comp", frame, "value", robust_threshold(scores, ["comp"], "value", z))
    return who, when


def correlated_cells(vectors: DataFrame, shuffled: list[DataFrame], vector: str, percent: float = 95.0) -> list[int]:
    """Places whose mean correlation with the others exceeds that share of the shuffled draws'."""
    from tracegrid.operators.linalg import correlations

    real = mean_correlation(correlations(vectors, vector))
    nulls = np.array([mean_correlation(correlations(s, vector)) for s in shuffled])
    return [int(k) for k in np.flatnonzero(real > np.nanpercentile(nulls, percent, axis=0))]


def ranked_cells(loadings: DataFrame, cell: str, value: str) -> DataFrame:
    """(cell, rank) by greatest loading, of equals by cell."""
    top = loadings.groupBy(cell).agg(F.max(value).alias("__m"))
    out = ranked(top.withColumn("__m", -F.col("__m")), "__m", [cell], "rank")
    return out.select(cell, (F.col("rank") + 1).cast("int").alias("rank"))


def stability(a: Components, b: Components) -> tuple[list[int], np.ndarray]:
    """For each component of a its match in b, one to one with the greatest sum of |correlation|, and these."""
    from tracegrid.operators.linalg import assigned

    corr = np.abs(np.corrcoef(a.loadings, b.loadings)[: len(a.loadings), len(a.loadings) :])
    match = assigned(corr)
    return match, corr[np.arange(len(match)), match]
