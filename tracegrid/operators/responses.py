"""Pulses, periodic stimulation and responses of pixels and cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.columns import wrapped
from tracegrid.operators.decoding import resampled_means
from tracegrid.operators.ordered import joined, windowed
from tracegrid.operators.series import median_filtered, rising
from tracegrid.operators.settle import settled
from tracegrid.operators.stats import levels_by, quantiles, scaled


def pulses(df: DataFrame, by: list[str], pos: str, value: str, size: int = 31, low: float = 0.1, high: float = 0.9, within: int = 200, outlier: float = 10.0) -> DataFrame:
    """(by, on, lag): rising edges through the low threshold that an edge through the high one confirms soon after.

    Each session's trace is scaled, median-filtered, and its two levels give both thresholds. Lags farther from the median lag
    than ``outlier`` times the median displacement go.
    """
    rows = median_filtered(scaled(df, by, value, "__y", 0.0), by, pos, "__y", "__y", size)
    ends = levels_by(rows, by, "__y", 2).groupBy(*by).agg(F.min("level").alias("__base"), F.max("level").alias("__top"))
    cut = lambda share: F.col("__base") + share * (F.col("__top") - F.col("__base"))
    rows = joined(rows, settled(ends), by)
    rows = rising(rising(rows, by, pos, "__y", cut(low), "__on"), by, pos, "__y", cut(high), "__up")
    ups = rows.where("__up").select(*by, F.col(pos).alias("__p"))
    near = rows.where("__on").select(*by, F.col(pos).alias("on")).withColumn("__p", F.explode(F.sequence(F.col("on"), F.col("on") + within)))
    lags = joined(near, ups, [*by, "__p"], "inner").groupBy(*by, "on").agg(F.min(F.col("__p") - F.col("on")).alias("lag"))
    mid = quantiles(lags, by, "lag", [0.5]).select(*by, F.col("q").alias("__m"))
    off = joined(lags, mid, by).withColumn("__d", F.abs(F.col("lag") - F.col("__m")))
    spread = quantiles(off, by, "__d", [0.5]).select(*by, F.col("q").alias("__s"))
    return joined(off, spread, by).where(F.col("__d") <= outlier * F.greatest(F.col("__s"), F.lit(1.0))).select(*by, "on", "lag")


def fourier(df: DataFrame, by: list[str], k: str, value: str, n: str, bin_: int = 1) -> DataFrame:
    """(by, re, im, amplitude, phase) of one bin of the discrete Fourier transform; k counts from 0 to n - 1."""
    angle = F.lit(-2 * math.pi * bin_) * F.col(k) / F.col(n)
    return df.groupBy(*by).agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), F.sum(F.col(value) * F.sin(angle)).alias("im")).withColumns({"amplitude": F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), "phase": F.atan2("im", "re")})


def phase_with(offset: Column, phase: str = "phase") -> Column:
    return wrapped(F.col(phase) + offset)


def field_sign(maps: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Add ``sign``: sine of the angle between the slopes of two maps, rows (row, col)."""
    made = {}
    for name, c in (("a", a), ("b", b)):
        for axis, over in (("r", "row"), ("c", "col")):
            made[f"__{name}{axis}"] = (c, over)
    for out, (c, over) in made.items():
        other = "col" if over == "row" else "row"
        slope = lambda w, c=c: F.when(F.lag(c).over(w).isNull(), F.lead(c).over(w) - F.col(c)).when(F.lead(c).over(w).isNull(), F.col(c) - F.lag(c).over(w)).otherwise((F.lead(c).over(w) - F.lag(c).over(w)) / 2)
        maps = windowed(maps, [*key, other], over, {out: slope})
    return maps.withColumn("sign", F.sin(F.atan2("__ar", "__ac") - F.atan2("__br", "__bc"))).drop(*made)


def trial_average(trials: DataFrame, by: list[str], rel: str, value: str) -> DataFrame:
    return trials.groupBy(*by, rel).agg(F.avg(value).alias(value))


def baseline_removed(trials: DataFrame, trial: list[str], rel: str, value: str, before: float) -> DataFrame:
    """value minus the trial's mean over ``before`` up to 0, which is left out."""
    base = trials.where((F.col(rel) >= -before) & (F.col(rel) < 0)).groupBy(*trial).agg(F.avg(value).alias("__b"))
    return joined(trials, base, trial).withColumn(value, F.col(value) - F.coalesce("__b", F.lit(0.0))).drop("__b")


def tuned(trials: DataFrame, by: list[str], trial: str, value: str, draws: int = 2000, percent: float = 99.865, seed: int = 0) -> DataFrame:
    """(by, response, cut, tuned): mean over trials against that percentile of resampled means of all the group's trials pooled."""
    keys = by[:-1]  # the last of ``by`` is the kind of trial; draws pool all kinds
    pooled = resampled_means(trials.select(*keys, trial, value), keys, trial, value, draws, seed)
    # As many values a group as there are draws, so a plain percentile holds few.
    cut = pooled.groupBy(*keys).agg(F.percentile("mean", percent / 100).alias("cut"))
    return joined(trials.groupBy(*by).agg(F.avg(value).alias("response")), cut, keys).withColumn("tuned", F.col("response") > F.col("cut"))
