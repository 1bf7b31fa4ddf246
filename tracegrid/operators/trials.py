"""Rows of trials, grids and flags: choosing kinds, numbering cells of arrays, and frames near to something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.asof import nearest
from tracegrid.operators.ordered import joined
from tracegrid.operators.series import detrend_sigma, detrended


def of_kinds(trials: DataFrame, kind: str, kinds: DataFrame) -> DataFrame:
    """Trials whose kind is in a table of kinds, of any length."""
    return trials.join(kinds.select(F.col(kinds.columns[0]).alias(kind)).distinct(), kind, "left_semi")


def unrolled(df: DataFrame, rel: str, trial: str, n: int, out: str = "at") -> DataFrame:
    """Add the place of each row when trials of n rows stand one after another."""
    return df.withColumn(out, F.col(trial).cast("bigint") * n + F.col(rel))


def rolled(df: DataFrame, at: str, n: int, rel: str = "rel", trial: str = "trial") -> DataFrame:
    """The same the other way round."""
    return df.withColumns({trial: F.floor(F.col(at) / n).cast("bigint"), rel: F.pmod(F.col(at), F.lit(n)).cast("bigint")})


def surface(vertices: DataFrame, order: str, columns: int, value: str) -> DataFrame:
    """(x, z, value): a flat list of vertices, numbered by ``order`` from 0, as a grid of so many columns."""
    return vertices.select(F.floor(F.col(order) / columns).cast("bigint").alias("x"), F.pmod(F.col(order), F.lit(columns)).cast("bigint").alias("z"), F.col(value))


def in_chunk(terrain: DataFrame, x: float = 0.0, z: float = 0.0) -> DataFrame:
    return terrain.where((F.col("chunk_x") == x) & (F.col("chunk_z") == z))


def near_something(view: DataFrame, beh: DataFrame, frames: DataFrame, by: list[str], pos: str, time: str, at: str, distance: float, width: float | None = None) -> DataFrame:
    """(by, at) of the frames at whose nearest sample something stood nearer than ``distance``; for a left semi join with every block."""
    close = view.where(F.col("dist") < distance).groupBy(*by, pos).agg(F.lit(1.0).alias("__near"))
    flags = joined(beh.select(*by, pos, time), close, [*by, pos]).na.fill(0.0, ["__near"])
    return nearest(frames.select(*by, at), flags, by, at, time, ["__near"], width).where(F.col("__near") > 0.5).select(*by, at)


def target_block(df: DataFrame, key: list[str], pos: str, block: str, columns: list[str], spec, seconds: float | None, fs: float, by: list[str] | None = None) -> DataFrame:
    """A block's columns less their trend, where the settings ask for that block; columns of presence go with skip."""
    sigma = detrend_sigma(block, spec, seconds, fs)
    if not sigma:
        return df.select(*key, *columns)
    rows = df
    for c in columns:
        rows = detrended(rows, by or [], pos, c, f"__{c}", sigma)
    return rows.select(*key, *[F.col(f"__{c}").alias(c) for c in columns])


def first_of(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """Rows whose place is among the first n."""
    return df.where(F.col(order) < n)


def least_place(grid: DataFrame, by: list[str], value: Column, row: str = "iz", col: str = "ix") -> DataFrame:
    """(by, iz, ix): where a grid is least, of equals the first by row, then column."""
    return grid.groupBy(*by).agg(F.min_by(F.struct(row, col), F.struct(value.alias("v"), row, col)).alias("__at")).select(*by, "__at.*")
