"""Terrain: what of it a frame shows, as pixels and boxes of them, finer grids of heights, and the search for its offset.

Terrain is rows (x, height, z) in world units, or a grid (gx, gz, height). Frames have x, y, z. NULL places meet nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions.columns import wrapped
from tracegrid.operators.ordered import joined
from tracegrid.operators.raster import splat
from tracegrid.operators.scene import Monitor
from tracegrid.operators.stats import quantiles


#: Pixels of all frames that one task paints.
PIXELS = 1 << 21


def dealt(frames: DataFrame, key: list[str], pixels: int, most: int = PIXELS) -> DataFrame:
    """Frames in as many parts as it takes to paint about ``most`` pixels in each, ``pixels`` being those of a frame's screen.

    A task then holds no more however many frames there are, and what is grouped by the key stays where it is.
    """
    return frames.repartition(max(1, math.ceil(frames.count() * pixels / most)), *key)


def in_cone(frames: DataFrame, cells: DataFrame, by: list[str], monitor: Monitor, phi: str | None = None, theta: str | None = None, eye: float = 0.0, tiles: int = 4) -> DataFrame:
    """(frame columns, cell_x, cell_z, height, dist, lat, vert) of each terrain cell that a frame shows.

    phi, theta: columns of the frames with the screen's direction, in place of the monitor's. Terrain lies in square
    tiles, ``tiles`` of them to the clipping distance. A frame asks for the tiles that touch its cone alone: those whose
    nearest corner may lie in reach, and whose centre lies within the opening widened by what the tile covers as seen
    from the frame. So the pairs that meet are those of tiles in view, and an exact test follows.
    """
    clip, width = float(monitor.clip), float(monitor.clip) / tiles
    heading = F.col(phi) if phi else F.lit(float(monitor.phi))
    raised = F.col(theta) if theta else F.lit(float(monitor.theta))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-tiles, tiles + 1) for j in range(-tiles, tiles + 1)])
    tile = lambda c: F.floor(F.col(c) / width).cast("bigint")
    half = width / math.sqrt(2)  # from a tile's centre to its corner
    away = lambda c, d: (tile(c) + F.col(f"__t.{d}") + 0.5) * width - F.col(c)
    asked = frames.withColumn("__t", F.explode(offsets)).withColumns({"__ax": away("x", "i"), "__az": away("z", "j")})
    far = F.sqrt(F.col("__ax") * F.col("__ax") + F.col("__az") * F.col("__az"))
    open_ = F.lit(monitor.h_fov / 2) + F.asin(F.least(F.lit(1.0), F.lit(half) / far))
    near = (far < clip + half) & ((far <= half) | (F.abs(wrapped(heading - F.atan2("__ax", "__az"))) <= open_))
    asked = asked.where(near).withColumns({"__tx": tile("x") + F.col("__t.i"), "__tz": tile("z") + F.col("__t.j")}).drop("__t", "__ax", "__az")
    ground = cells.select(*[F.col(b).alias(f"__c_{b}") for b in by], F.col("x").alias("cell_x"), F.col("z").alias("cell_z"), "height", tile("x").alias("__cx"), tile("z").alias("__cz"))
    on = [F.col(b).eqNullSafe(F.col(f"__c_{b}")) for b in by] + [F.col("__tx") == F.col("__cx"), F.col("__tz") == F.col("__cz")]
    met = asked.join(ground, on)
    dx, dy, dz = F.col("cell_x") - F.col("x"), F.col("height") - F.col("y") - F.lit(float(eye)), F.col("cell_z") - F.col("z")
    flat = F.sqrt(dx * dx + dz * dz)
    met = met.withColumns({"dist": F.sqrt(dx * dx + dy * dy + dz * dz), "lat": wrapped(heading - F.atan2(dx, dz)), "vert": wrapped(raised - F.atan2(flat, dy))})
    seen = (F.col("dist") < clip) & (F.col("dist") > 1e-6) & (F.abs("lat") < monitor.h_fov / 2) & (F.abs("vert") < monitor.v_fov / 2)
    return met.where(seen).select(*frames.columns, "cell_x", "cell_z", "height", "dist", "lat", "vert")


def pixel(angle: str, fov: float, samples: int) -> Column:
    """Where an angle falls on a screen's samples, halves to the even one; ``projected`` is the same before rounding."""
    return F.bround(projected(angle, fov, samples)).cast("int")


def projected(angle: str, fov: float, samples: int) -> Column:
    return (F.lit(fov / 2) - F.col(angle)) / fov * (samples - 1)


def painted_points(view: DataFrame, key: list[str], monitor: Monitor, width: int, height: int, brightest: float = 200.0, point: int = 1) -> DataFrame:
    """(key, row, col, value, depth): of the points that fall on a pixel the brightest, and the least distance.

    A point covers a square of 2 * point - 1 pixels and is the darker the farther it is, nothing at the clipping distance.
    """
    value = F.floor(F.greatest(F.lit(0.0), brightest * (1 - F.col("dist") / float(monitor.clip)))).cast("int")
    around = F.array(*map(F.lit, range(1 - point, point)))
    rows = view.select(*key, pixel("vert", monitor.v_fov, height).alias("row"), pixel("lat", monitor.h_fov, width).alias("col"), value.alias("value"), F.col("dist").alias("depth"))
    if point > 1:
        rows = rows.withColumn("__i", F.explode(around)).withColumn("__j", F.explode(around)).withColumns({"row": F.col("row") + F.col("__i"), "col": F.col("col") + F.col("__j")}).drop("__i", "__j")
        rows = rows.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return splat(rows, [*key, "row", "col"])


def boxes(pixels: DataFrame, frames: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, top, bottom, left, right, nearest) of each frame's painted pixels; n is 0 and the rest NULL where there are none."""
    found = pixels.groupBy(*key).agg(F.count("*").alias("n"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"), F.min("depth").alias("nearest"))
    return joined(frames.select(*key).distinct(), found, key).na.fill(0, ["n"])


def surfaces(grid: DataFrame, chunk: list[str]) -> DataFrame:
    """(chunk, gx, gz, a, b, c, d): heights between the corners (gx, gz) and (gx + 1, gz + 1) as a + b tx + c tz + d tx tz."""
    corner = F.explode(F.array(*[F.struct((F.col("gx") - i).alias("gx"), (F.col("gz") - j).alias("gz"), F.lit(2 * i + j).alias("k")) for i in (0, 1) for j in (0, 1)]))
    dealt = grid.select(*chunk, corner.alias("__p"), "height").select(*chunk, "__p.*", "height")
    h = dealt.groupBy(*chunk, "gx", "gz").agg(*[F.max(F.when(F.col("k") == k, F.col("height"))).cast("double").alias(f"h{k}") for k in range(4)])
    h = h.na.drop(subset=[f"h{k}" for k in range(4)])
    return h.select(*chunk, "gx", "gz", F.col("h0").alias("a"), (F.col("h2") - F.col("h0")).alias("b"), (F.col("h1") - F.col("h0")).alias("c"), (F.col("h0") + F.col("h3") - F.col("h1") - F.col("h2")).alias("d"))


def upsampled(grid: DataFrame, chunk: list[str], nx: int, nz: int, stride: float) -> DataFrame:
    """(chunk, gx, gz, x, z, height): a finer grid of each chunk of nx by nz heights, bilinear between them.

    There are round(n / stride) places along an axis, from the first to the last of the old ones; x and z are theirs in old cells.
    Each place belongs to one square of the old grid, whose surface is computed once and read by all places in it.
    """
    mx, mz = round(nx / stride), round(nz / stride)
    if min(mx, mz, nx, nz) < 2:
        raise ValueError("a grid of at least 2 by 2 heights")
    cells = surfaces(grid, chunk)
    step = lambda n, m: (n - 1) / (m - 1)
    # The last place lies on the old grid's far edge, in the last square.
    first = lambda g, n, m: F.ceil(F.col(g) / step(n, m) - 1e-9)
    last = lambda g, n, m: F.when(F.col(g) == n - 2, F.lit(m - 1).cast("bigint")).otherwise(F.ceil((F.col(g) + 1) / step(n, m) - 1e-9) - 1)
    span = lambda g, n, m: F.when(last(g, n, m) >= first(g, n, m), F.sequence(first(g, n, m), last(g, n, m)))
    fine = cells.withColumn("__i", F.explode(span("gx", nx, mx))).withColumn("__j", F.explode(span("gz", nz, mz)))
    fine = fine.withColumns({"x": F.col("__i") * step(nx, mx), "z": F.col("__j") * step(nz, mz)})
    tx, tz = F.col("x") - F.col("gx"), F.col("z") - F.col("gz")
    height = F.col("a") + F.col("b") * tx + F.col("c") * tz + F.col("d") * tx * tz
    return fine.select(*chunk, F.col("__i").alias("gx"), F.col("__j").alias("gz"), "x", "z", height.alias("height"))


#: How near the far edge a place outside the grid is kept.
EDGE = 1e-6


def offset_moments(points: DataFrame, grid: DataFrame, offsets: list[tuple[int, int]], nx: int, nz: int, y: str = "y") -> DataFrame:
    """(ox, oz, mean, std) of y minus the bilinear height at (x + ox, z + oz), for whole-numbered offsets; places outside are kept at the edge.

    Points are read once: a height is a polynomial in the place within a square, so fourteen sums for each square hold
    all that any offset's mean and deviation need. Squares, not points, meet the offsets.
    """
    tx, tz = F.col("x") - F.floor("x"), F.col("z") - F.floor("z")
    power = lambda t, k: F.lit(1.0) if k == 0 else t if k == 1 else t * t
    aggs = [F.sum(power(tx, i) * power(tz, j)).alias(f"s{i}{j}") for i in range(3) for j in range(3)]
    aggs += [F.sum(F.col(y) * power(tx, i) * power(tz, j)).alias(f"y{i}{j}") for i in range(2) for j in range(2)] + [F.sum(F.col(y) * F.col(y)).alias("yy")]
    sums = points.na.drop(subset=["x", "z", y]).groupBy(F.floor("x").alias("px"), F.floor("z").alias("pz")).agg(*aggs)
    asked = sums.withColumn("__o", F.explode(F.array(*[F.struct(F.lit(a).alias("ox"), F.lit(b).alias("oz")) for a, b in offsets]))).select("*", "__o.*")

    def kept(p: str, o: str, n: int) -> tuple[Column, Column]:
        """(square, where in it all points are if they were outside, else NULL)."""
        at = F.col(p) + F.col(o)
        return F.greatest(F.lit(0), F.least(at, F.lit(n - 2))), F.when(at < 0, 0.0).when(at > n - 2, 1.0 - EDGE)

    gx, cx = kept("px", "ox", nx)
    gz, cz = kept("pz", "oz", nz)
    asked = asked.withColumns({"gx": gx, "gz": gz, "__cx": cx, "__cz": cz}).join(surfaces(grid, []), ["gx", "gz"])

    def held(name: str, i: int, j: int) -> Column:
        """The sum with tx**i tz**j where points stay in their square, else with the edge's place in the stead of theirs."""
        both = F.col(f"{name}{i}{j}")
        out = both
        if i:
            out = F.when(F.col("__cx").isNotNull(), F.pow("__cx", F.lit(i)) * F.col(f"{name}0{j}")).otherwise(out)
        if j:
            fixed = F.pow("__cz", F.lit(j))
            rest = F.when(F.col("__cx").isNotNull(), F.pow("__cx", F.lit(i)) * F.col(f"{name}00")).otherwise(F.col(f"{name}{i}0")) if i else F.col(f"{name}00")
            out = F.when(F.col("__cz").isNotNull(), fixed * rest).otherwise(out)
        return out

    terms = {"a": (0, 0), "b": (1, 0), "c": (0, 1), "d": (1, 1)}
    total = held("y", 0, 0) - sum((F.col(k) * held("s", *p) for k, p in terms.items()), F.lit(0.0))
    square = F.col("yy") - 2 * sum((F.col(k) * held("y", *p) for k, p in terms.items()), F.lit(0.0))
    for k, p in terms.items():
        for m, q in terms.items():
            square = square + F.col(k) * F.col(m) * held("s", p[0] + q[0], p[1] + q[1])
    rows = asked.groupBy("ox", "oz").agg(F.sum("s00").alias("__n"), F.sum(total).alias("__t"), F.sum(square).alias("__q"))
    mean = F.col("__t") / F.col("__n")
    return rows.select("ox", "oz", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("__n") - mean * mean)).alias("std"))


def offset_deltas(points: DataFrame, grid: DataFrame, offsets: list[tuple[int, int]], nx: int, nz: int, y: str = "y") -> DataFrame:
    """(ox, oz, delta): a row for each point and offset, for what sums can't tell (``offset_peaks``)."""
    rows = points.na.drop(subset=["x", "z", y]).withColumn("__o", F.explode(F.array(*[F.struct(F.lit(a).alias("ox"), F.lit(b).alias("oz")) for a, b in offsets])))
    rows = rows.select("__o.*", F.col(y).alias("__y"), *[F.greatest(F.lit(0.0), F.least(F.col(c) + F.col(f"__o.{o}"), F.lit(n - 1 - EDGE))).alias(f"__{c}") for c, o, n in (("x", "ox", nx), ("z", "oz", nz))])
    rows = rows.withColumns({"gx": F.floor("__x"), "gz": F.floor("__z")}).join(surfaces(grid, []), ["gx", "gz"])
    tx, tz = F.col("__x") - F.col("gx"), F.col("__z") - F.col("gz")
    return rows.select("ox", "oz", (F.col("__y") - (F.col("a") + F.col("b") * tx + F.col("c") * tz + F.col("d") * tx * tz)).alias("delta"))


def offset_peaks(deltas: DataFrame, bins: int = 200, sigma: float = 2.0) -> DataFrame:
    """(ox, oz, median, peak): peak is the centre of the fullest of ``bins`` equal bins of the offset's own range, after smoothing; of equals the first."""
    from tracegrid.operators.series import smoothed

    by = ["ox", "oz"]
    ends = deltas.groupBy(*by).agg(F.min("delta").alias("__lo"), F.max("delta").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("delta") - F.col("__lo"), width))), F.lit(0)).cast("int")
    counts = joined(deltas, ends, by).groupBy(*by, at.alias("bin")).agg(F.count("*").cast("double").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    every = joined(every, counts, [*by, "bin"]).na.fill(0.0, ["n"])
    if sigma:
        every = smoothed(every, by, "bin", {"n": "n"}, sigma, "even", "reflect")
    top = every.groupBy(*by).agg(F.max_by(F.col("__lo") + (F.col("bin") + 0.5) * width, F.struct(F.col("n"), -F.col("bin"))).alias("peak"))
    return joined(joined(top, quantiles(deltas, by, "delta", [0.5]).withColumnRenamed("q", "median"), by), ends.select(*by), by).select(*by, "median", "peak")


def best_offsets(sweep: DataFrame, expected: float, by: str = "std median peak") -> DataFrame:
    """(rule, ox, oz): the offset with the least deviation, and those whose median and peak lie nearest what is expected; of equals the first by (oz, ox)."""
    forms = {"std": F.col("std"), "median": F.abs(F.col("median") - expected), "peak": F.abs(F.col("peak") - expected)}
    rows = sweep.select("ox", "oz", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), forms[r].alias("v")) for r in by.split()])).alias("r")).select("ox", "oz", "r.*")
    order = Window.partitionBy("rule").orderBy("v", "oz", "ox")  # a row for each offset
    return rows.where(F.col("v").isNotNull()).withColumn("__r", F.row_number().over(order)).where("__r = 1").select("rule", "ox", "oz")
