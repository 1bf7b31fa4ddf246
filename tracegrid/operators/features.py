"""Feature blocks of movement and events, sensor maps and simple reports. Positions are dense, from 0.

NULL values count as in the operators that each is made of; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.asof import interpolated
from tracegrid.operators.ordered import joined, ranked, running
from tracegrid.operators.series import difference, gradient, movement, smoothed, unwrapped


def movement_frame(spine: DataFrame, samples: DataFrame, by: list[str], at: str, time: str, pos: str, width: float | None = None) -> DataFrame:
    """The spine (by, at, pos) with x, y, z and heading read off the samples, and what changed since the row before.

    Headings are interpolated by sine and cosine. Ends are clamped.
    """
    rows = samples.withColumns({"__s": F.sin("heading"), "__c": F.cos("heading")})
    met = interpolated(spine, rows, by, at, time, ["x", "y", "z", "__s", "__c"], "linear", "clamp", width)
    met = met.withColumn("heading", F.atan2("__s", "__c")).drop("__s", "__c")
    return movement(met, by, pos, "x", "y", "z", "heading")


def self_motion(df: DataFrame, by: list[str], pos: str, sigma: float = 2.0, step: float = 0.1) -> DataFrame:
    """Add speed and yaw_rate: gradients of the smoothed place (x, z) and of the smoothed, unwrapped heading per second."""
    rows = unwrapped(df, by, pos, "heading", "__phi")
    rows = smoothed(rows, by, pos, {"__x": "x", "__z": "z", "__p": "__phi"}, sigma, "even", "nearest")
    for value, out in (("__x", "__dx"), ("__z", "__dz"), ("__p", "__dp")):
        rows = gradient(rows, by, pos, value, out)
    speed = F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dz") * F.col("__dz")) / step
    return rows.withColumns({"speed": speed, "yaw_rate": F.col("__dp") / step}).drop("__phi", "__x", "__z", "__p", "__dx", "__dz", "__dp")


def event_features(df: DataFrame, by: list[str], pos: str, counts: list[str], sigma: float = 0.0) -> DataFrame:
    """Counts of events on each frame, smoothed in place if sigma is not 0."""
    return smoothed(df, by, pos, {c: c for c in counts}, sigma, "even", "nearest")


def turned(df: DataFrame, by: list[str], pos: str, channels: list[str], mix: dict[str, list[float]], scale: float = 1000.0) -> DataFrame:
    """Add, for each name in mix, a weighted sum of the channels' changes over ``scale``, and its running sum (name_sum)."""
    rows = df
    for c in channels:
        rows = difference(rows, by, pos, c, f"__d_{c}")
    step = lambda w: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"__d_{c}"), F.lit(0.0)) / scale * x for c, x in zip(channels, w, strict=True)])
    rows = rows.withColumns({k: step(w) for k, w in mix.items()}).drop(*[f"__d_{c}" for c in channels])
    return running(rows, by, pos, {f"{k}_sum": F.col(k) for k in mix})


def period_ratio(df: DataFrame, periods: DataFrame, by: list[str], pos: str, a: str, b: str) -> DataFrame:
    """(by, period, pos, ratio): inside periods (by, period, first, last), both channels minus their value at its first row, divided; NULL by 0."""
    met = joined(periods.withColumn(pos, F.explode(F.sequence("first", "last"))), df.select(*by, pos, a, b), [*by, pos], "inner")
    start = met.groupBy(*by, "period").agg(F.min_by(a, pos).alias("__a"), F.min_by(b, pos).alias("__b"))
    rows = joined(met, start, [*by, "period"])
    return rows.select(*by, "period", pos, F.try_divide(F.col(a) - F.col("__a"), F.col(b) - F.col("__b")).alias("ratio"))


def normalised_trace(df: DataFrame, by: list[str], pos: str, value: str, out: str, sigma: float = 10.0) -> DataFrame:
    """value minus the series' first, smoothed, over the population deviation of what is left."""
    first = df.groupBy(*by).agg(F.min_by(value, pos).alias("__first"))
    rows = joined(df, first, by).withColumn("__v", F.col(value) - F.col("__first"))
    rows = smoothed(rows, by, pos, {"__y": "__v"}, sigma, "even", "reflect")
    rows = joined(rows, rows.groupBy(*by).agg(F.stddev_pop("__y").alias("__sd")), by)
    return rows.withColumn(out, F.try_divide("__y", "__sd")).drop("__first", "__v", "__y", "__sd")


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, missing, low, high) of each column: share of NULL or NaN, and the range of what is there."""
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), value(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    return rows.groupBy("name").agg(F.avg(F.col("v").isNull().cast("double")).alias("missing"), F.min("v").alias("low"), F.max("v").alias("high"))


def world_coordinates(objects: DataFrame, axes: list[str], limit: float = 200.0) -> DataFrame:
    """(axis, low, high, world): ranges of coordinates, and whether any of them lies beyond the limit, as in world units."""
    rows = missing_report(objects, axes)
    return rows.select(F.col("name").alias("axis"), "low", "high", F.coalesce(F.greatest(F.abs("low"), F.abs("high")) > limit, F.lit(False)).alias("world"))


def stacked(parts: list[DataFrame], index: str = "dset_idx") -> DataFrame:
    """Datasets of the same columns under one another, with the place of each in the list."""
    return reduce(DataFrame.unionByName, [p.withColumn(index, F.lit(n)) for n, p in enumerate(parts)])


def every_nth(df: DataFrame, pos: str, n: int) -> DataFrame:
    return df.where(F.pmod(F.col(pos), F.lit(n)) == 0)


def strided(terrain: DataFrame, stride: float) -> DataFrame:
    """Terrain cells whose both indices divide by the stride; a fraction over 1 is cut down, under 1 all cells stay."""
    n = max(1, int(stride))
    return terrain.where((F.pmod(F.col("x"), F.lit(n)) == 0) & (F.pmod(F.col("z"), F.lit(n)) == 0))


def striped(pixels: DataFrame, height: int, top: int = 255, bottom: int = 128, width: int = 3) -> DataFrame:
    """Pixels with the first rows painted one value and the last rows another."""
    return pixels.withColumn("value", F.when(F.col("row") < width, top).when(F.col("row") >= height - width, bottom).otherwise(F.col("value")))


def by_distance(objects: DataFrame, key: str, place: tuple[float, float, float]) -> DataFrame:
    """Objects (x, y, z) with their distance from one place and their rank by it, of equals by key."""
    dist = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.lit(p), 2) for c, p in zip("xyz", place, strict=True)]))
    rows = ranked(objects.withColumn("dist", dist), "dist", [key], "rank")
    return rows.withColumn("rank", (F.col("rank") + 1).cast("int"))


def pooled_cut(values: DataFrame, value: str, percent: float) -> DataFrame:
    """(upper): one percentile of all components' shuffled values together."""
    from tracegrid.operators.stats import quantiles

    return quantiles(values, [], value, [percent / 100]).select(F.col("q").alias("upper"))


def splits(df: DataFrame, dist: str = "d_dist", turn: str = "d_phi", least: float = 0.01) -> dict[str, Column]:
    """Boolean columns of a movement frame: moving, and turning left."""
    return {"moving": F.coalesce(F.col(dist) > least, F.lit(False)), "left": F.coalesce(F.col(turn) > 0, F.lit(False))}
