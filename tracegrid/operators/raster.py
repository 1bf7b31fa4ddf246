"""Pixels as rows: silhouettes, depth, pooling over grids of cells, edge energy and optical flow.

A picture is rows (frame, row, col, value). Work is grouped by frame and pixel or cell, so no frame is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.columns import bounds, cell_of, ratio
from tracegrid.operators.ordered import joined, windowed
from tracegrid.operators.scene import Monitor


def _box(monitor: Monitor, width: int, height: int, x: float, y: float, ground: float | None) -> dict[str, Column]:
    """Centre and half extents in pixels; up and left are the small numbers. ground: how far the centre is above it."""
    px = lambda size, fov, n: F.atan2(F.lit(float(size)), F.col("dist")) / fov * (n - 1)
    at = lambda angle, fov, n: (F.lit(fov / 2) - F.col(angle)) / fov * (n - 1)
    up = px(y / 2, monitor.v_fov, height)
    return {"__cx": at("lat", monitor.h_fov, width), "__cy": at("vert", monitor.v_fov, height), "__hx": px(x, monitor.h_fov, width), "__up": up, "__down": up if ground is None else px(ground, monitor.v_fov, height)}


def silhouettes(view: DataFrame, key: list[str], monitor: Monitor, width: int, height: int, x: float, y: float, ground: float | None = None, raw: bool = False) -> DataFrame:
    """(key, row, col, value, depth): anti-aliased filled boxes of what is in view.

    Coverage of a pixel is its overlap with the box; objects combine as 255 (1 - product of what each leaves uncovered),
    cut down to a whole number; depth is the least distance among objects that cover some of the pixel.
    raw: ``cover`` from 0 to 1 in place of ``value``. A row counts ``n`` times if it has that.
    """
    rows = view.withColumns(_box(monitor, width, height, x, y, ground))
    left, right, top, low = F.col("__cx") - F.col("__hx"), F.col("__cx") + F.col("__hx"), F.col("__cy") - F.col("__up"), F.col("__cy") + F.col("__down")
    rows = rows.withColumns({"__l": left, "__r": right, "__t": top, "__d": low})
    pixels = lambda lo, hi, n: F.sequence(F.greatest(F.lit(0), F.floor(F.col(lo)).cast("int")), F.least(F.lit(n - 1), F.ceil(F.col(hi)).cast("int")))
    some = lambda lo, hi, n: (F.ceil(F.col(hi)) >= 0) & (F.floor(F.col(lo)) <= n - 1)
    rows = rows.where(some("__l", "__r", width) & some("__t", "__d", height))
    rows = rows.withColumn("col", F.explode(pixels("__l", "__r", width))).withColumn("row", F.explode(pixels("__t", "__d", height)))
    cover = lambda p, lo, hi: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(F.col(p) + 0.5, F.col(hi)) - F.greatest(F.col(p) - 0.5, F.col(lo))))
    rows = rows.withColumn("__c", cover("col", "__l", "__r") * cover("row", "__t", "__d")).where("__c > 0")
    left_out = 1 - F.col("__c")
    covered = 1 - F.product(F.pow(left_out, F.col("n")) if "n" in view.columns else left_out)
    return rows.groupBy(*key, "row", "col").agg(covered.alias("cover") if raw else F.floor(255 * covered).cast("int").alias("value"), F.min("dist").alias("depth"))


def outlines(view: DataFrame, key: list[str], monitor: Monitor, width: int, height: int, x: float, y: float, ground: float) -> DataFrame:
    """(key, row, col): border and centre pixels of boxes with rounded edges, the right one a pixel further out."""
    rows = view.withColumns({k: F.bround(c).cast("int") for k, c in _box(monitor, width, height, x, y, ground).items()})
    rows = rows.withColumns({"__l": F.col("__cx") - F.col("__hx"), "__r": F.col("__cx") + F.col("__hx") + 1, "__t": F.col("__cy") - F.col("__up"), "__d": F.col("__cy") + F.col("__down")})
    at = lambda r, c: F.struct(r.alias("row"), c.alias("col"))
    across = F.sequence(F.col("__l"), F.col("__r"))
    down = F.sequence(F.col("__t"), F.col("__d"))
    border = F.concat(F.transform(across, lambda c: at(F.col("__t"), c)), F.transform(across, lambda c: at(F.col("__d"), c)), F.transform(down, lambda r: at(r, F.col("__l"))), F.transform(down, lambda r: at(r, F.col("__r"))), F.array(at(F.col("__cy"), F.col("__cx"))))
    found = rows.select(*key, F.explode(border).alias("p")).select(*key, "p.*")
    return found.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def layered(layers: DataFrame, pixel: list[str]) -> DataFrame:
    """Of layers (pixel, layer, value, depth) the nearest in each pixel; of equals the later layer; no depth: 0."""
    seen = layers.where(F.col("depth").isNotNull() & (F.col("depth") < float("inf")))
    top = seen.groupBy(*pixel).agg(F.min_by("value", F.struct(F.col("depth"), -F.col("layer"))).alias("value"), F.min("depth").alias("depth"))
    return joined(layers.select(*pixel).distinct(), top, pixel).withColumn("value", F.coalesce("value", F.lit(0)))


def splat(points: DataFrame, pixel: list[str]) -> DataFrame:
    """Largest value and least depth of the points in each pixel."""
    return points.groupBy(*pixel).agg(F.max("value").alias("value"), F.min("depth").alias("depth"))


def uncovered(df: DataFrame, pixel: list[str], coverage: str) -> DataFrame:
    """(pixel, value): 255 (1 - product of 1 - coverage), cut down to a whole number."""
    return df.groupBy(*pixel).agg(F.floor(255 * (1 - F.product(1 - F.col(coverage)))).cast("int").alias("value"))


def in_cells(pixels: DataFrame, height: int, width: int, grid: tuple[int, int]) -> DataFrame:
    return pixels.withColumns({"iy": cell_of(F.col("row"), bounds(height, grid[0])), "ix": cell_of(F.col("col"), bounds(width, grid[1]))})


def pooled(pixels: DataFrame, key: list[str], height: int, width: int, grid: tuple[int, int], values: list[str]) -> DataFrame:
    return in_cells(pixels, height, width, grid).groupBy(*key, "iy", "ix").agg(*[F.sum(v).alias(v) for v in values])


def _slopes(pixels: DataFrame, key: list[str], value: str) -> DataFrame:
    """Add gy and gx: central differences along rows and columns, one-sided at the ends of what ``key`` holds together."""

    def along(w) -> Column:
        a, x, b = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
        return F.when(a.isNull() & b.isNull(), F.lit(0.0)).when(a.isNull(), b - x).when(b.isNull(), x - a).otherwise((b - a) / 2)

    out = windowed(pixels, [*key, "col"], "row", {"gy": along})
    return windowed(out, [*key, "row"], "col", {"gx": along})


def cell_statistics(pixels: DataFrame, key: list[str], height: int, width: int, grid: tuple[int, int], value: str = "value") -> DataFrame:
    """(key, iy, ix, occ, mean, edge): share of pixels over 0, mean, and mean size of the slope within the cell alone. Every pixel has a row."""
    rows = _slopes(in_cells(pixels, height, width, grid), [*key, "iy", "ix"], value)
    return rows.groupBy(*key, "iy", "ix").agg(F.avg((F.col(value) > 0).cast("double")).alias("occ"), F.avg(value).alias("mean"), F.avg(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("edge"))


def flow(pixels: DataFrame, key: list[str], frame: str, height: int, width: int, grid: tuple[int, int], value: str = "value", damping: float = 1e-3) -> DataFrame:
    """(key, frame, iy, ix, u, v, speed, dirsin, dircos, div): least-squares motion of each cell since the frame before.

    Slopes run over the whole frame; a 2 x 2 system with damping on its diagonal is solved for each cell; divergence is
    taken on the grid of cells. The first frame has no motion.
    """
    rows = windowed(pixels, [*key, "row", "col"], frame, {"__it": lambda w: F.col(value) - F.lag(value).over(w)}, 1, 0)
    rows = _slopes(rows, [*key, frame], value)
    p = {"xx": "gx * gx", "yy": "gy * gy", "xy": "gx * gy", "xt": "gx * __it", "yt": "gy * __it"}
    sums = in_cells(rows, height, width, grid).groupBy(*key, frame, "iy", "ix").agg(*[F.sum(F.expr(e)).alias(k) for k, e in p.items()])
    xx, yy, xy, xt, yt = F.col("xx") + damping, F.col("yy") + damping, F.col("xy"), F.col("xt"), F.col("yt")
    det = xx * yy - xy * xy
    moved = sums.select(*key, frame, "iy", "ix", F.coalesce(ratio(xy * yt - yy * xt, det), F.lit(0.0)).alias("u"), F.coalesce(ratio(xy * xt - xx * yt, det), F.lit(0.0)).alias("v"))
    turn = F.atan2("v", "u")
    cells = moved.withColumns({"speed": F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")), "dirsin": F.sin(turn), "dircos": F.cos(turn), "row": F.col("iy"), "col": F.col("ix")})
    cells = _slopes(cells, [*key, frame], "u").drop("gy").withColumnRenamed("gx", "__ux")
    cells = _slopes(cells, [*key, frame], "v").drop("gx")
    div = F.col("__ux") + F.col("gy") if min(grid) > 1 else F.lit(0.0)
    return cells.withColumn("div", div).drop("__ux", "gy", "row", "col")


def painted(cells: DataFrame, key: list[str], height: int, width: int, grid: tuple[int, int], value: str) -> DataFrame:
    """(key, row, col, value): every pixel with its cell's value."""
    ys, xs = (F.array(*[F.lit(e) for e in bounds(n, g)]) for n, g in ((height, grid[0]), (width, grid[1])))
    span = lambda edges, i: F.sequence(F.get(edges, F.col(i)), F.get(edges, F.col(i) + 1) - 1)
    return cells.withColumn("row", F.explode(span(ys, "iy"))).withColumn("col", F.explode(span(xs, "ix"))).select(*key, "row", "col", value)
