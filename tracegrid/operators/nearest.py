"""Nearest neighbour in the plane by squares of growing width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.settle import settled


def widening(points: DataFrame, cells: DataFrame, key: list[str], values: list[str], pitch: float, most: int = 40) -> DataFrame:
    """Exact nearest cell for every point; see scene.nearest_cells. Cells at one place count once. Wider squares are only
    asked by points that stand alone; points farther than 2 ** most pitches from every cell have no row."""
    cells = cells.groupBy("x", "z").agg(F.min(F.struct(*values)).alias("__val"))
    open_, done, width = points.select(*key, "x", "z").where("x is not null and z is not null"), None, float(pitch)
    square = lambda c: F.floor(F.col(c) / width).cast("bigint")
    around = F.array(*map(F.lit, (-1, 0, 1)))
    for turn in range(most):
        dealt = cells.select(square("x").alias("__sx"), square("z").alias("__sz"), F.col("x").alias("cx"), F.col("z").alias("cz"), "__val")
        asked = open_.withColumn("__i", F.explode(around)).withColumn("__j", F.explode(around)).withColumns({"__sx": square("x") + F.col("__i"), "__sz": square("z") + F.col("__j")}).drop("__i", "__j")
        dist = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("z") - F.col("cz"), 2))
        met = asked.join(dealt, ["__sx", "__sz"]).withColumn("cell_dist", dist).where(F.col("cell_dist") <= width)
        best = met.groupBy(*key, "x", "z").agg(F.min_by(F.struct("cell_dist", "__val"), F.struct("cell_dist", "cz", "cx")).alias("b"))
        best = settled(best.select(*key, "x", "z", "b.cell_dist", "b.__val.*"))
        done = best if done is None else done.unionByName(best)
        same = [open_[c].eqNullSafe(best[c]) for c in [*key, "x", "z"]]
        open_ = settled(open_.join(best, same, "left_anti"))
        if turn == most - 1 or open_.isEmpty() or cells.isEmpty():
            return done
        width *= 2
