"""Movies: smoothing along all axes, dense optical flow, and blocks of features from pictures.

A movie is rows (key, frame, row, col, value), or packed: (key, frame, pixels), a frame's values row by row. A frame is a
picture of bounded size and may lie in one task; a movie may not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.columns import bounds
from tracegrid.operators.asof import interpolated
from tracegrid.operators.linalg import Components, matrix, principal, scores
from tracegrid.operators.ordered import joined
from tracegrid.operators.series import smoothed


def smoothed_movie(pixels: DataFrame, key: list[str], frame: str, value: str, out: str, sigmas: tuple[float, float, float]) -> DataFrame:
    """Add ``out``: a Gaussian along frames, rows and columns, divided by what the same gives for ones, so that edges keep their height.

    Each axis is a pass of bounded windows along it; the weight of ones goes along as a column. Absent pixels and NULL
    have no weight; a pixel without weight stays NULL.
    """
    rows = pixels.withColumns({"__v": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "__w": F.col(value).isNotNull().cast("double")})
    axes = [frame, "row", "col"]
    for axis, sigma in zip(axes, sigmas, strict=True):
        if sigma:
            rows = smoothed(rows, [*key, *[a for a in axes if a != axis]], axis, {"__v": "__v", "__w": "__w"}, sigma, "even", "zero")
    return rows.withColumn(out, F.try_divide("__v", "__w")).drop("__v", "__w")


def frame_means(pixels: DataFrame, key: list[str], frame: str, value: str) -> DataFrame:
    """(key, frame, mean): the mean of each frame's pixels."""
    return pixels.groupBy(*key, frame).agg(F.avg(value).alias("mean"))


def pixel_means(pixels: DataFrame, key: list[str], frame: str, value: str, first: int | None = None) -> DataFrame:
    """(key, row, col, mean): the mean of each pixel over frames, or over those before ``first``."""
    rows = pixels if first is None else pixels.where(F.col(frame) < first)
    return rows.groupBy(*key, "row", "col").agg(F.avg(value).alias("mean"))


def footprint(parts: DataFrame, key: list[str], weight: str) -> DataFrame:
    """(key, row, col, weight): what sparse pictures (one row a pixel in use) add up to."""
    return parts.groupBy(*key, "row", "col").agg(F.sum(weight).alias(weight))


def packed(pixels: DataFrame, key: list[str], frame: str, height: int, width: int, value: str = "value") -> DataFrame:
    """(key, frame, pixels): absent and NULL pixels are 0, and of a pixel given twice the greater counts."""
    inside = pixels.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1) & F.col(value).isNotNull())
    at = (F.col("row") * width + F.col("col")).cast("int")
    inside = inside.groupBy(*key, frame, at.alias("at")).agg(F.max(F.col(value).cast("double")).alias("v"))
    lists = inside.groupBy(*key, frame).agg(F.collect_list(F.struct("at", "v")).alias("__p"))  # a frame's pixels
    rows = joined(pixels.select(*key, frame).distinct(), lists, [*key, frame]).withColumn("__m", F.map_from_entries(F.transform("__p", lambda p: F.struct(p["at"], p["v"]))))
    # The map is named twice, so that it is not made anew for every pixel.
    at_all = F.sequence(F.lit(0), F.lit(height * width - 1))
    return rows.select(*key, frame, F.transform(at_all, lambda k: F.when(F.col("__m").isNotNull(), F.coalesce(F.try_element_at("__m", k), F.lit(0.0))).otherwise(0.0)).alias("pixels"))


def _kernel(sigma: float, reach: int) -> np.ndarray:
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return w / w.sum()


def _along(pictures: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
    """Correlation of pictures with w along an axis, the border pixel repeated."""
    r = len(w) // 2
    pad = [(0, 0)] * pictures.ndim
    pad[axis] = (r, r)
    full = np.pad(pictures, pad, mode="edge")
    n = pictures.shape[axis]
    return sum(x * np.take(full, range(k, k + n), axis=axis) for k, x in enumerate(w))


def expansions(pictures: np.ndarray, sigma: float = 1.1, reach: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(A, b) about every pixel: the weighted least-squares fit of x'Ax + b'x + c, x = (row, col), for pictures x height x width.

    A has (rr, rc, cc) last, b (r, c). The fit's sums are separable, and the border pixel stands for what lies beyond.
    """
    w, t = _kernel(sigma, reach), np.arange(-reach, reach + 1.0)
    base = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    gram = np.array([[float((w * t ** (a + c)).sum() * (w * t ** (b + d)).sum()) for c, d in base] for a, b in base])
    rows = {a: _along(pictures, w * t**a, 1) for a in (0, 1, 2)}
    sums = np.stack([_along(rows[a], w * t**b, 2) for a, b in base], axis=-1)
    _, r, c, rr, cc, rc = np.moveaxis(sums @ np.linalg.inv(gram).T, -1, 0)
    return np.stack([rr, rc / 2, cc], axis=-1), np.stack([r, c], axis=-1)


def displacement(before: np.ndarray, after: np.ndarray, rounds: int = 3, window: float = 3.0, scales: int = 2, damping: float = 1e-6) -> np.ndarray:
    """How far (rows, cols) each pixel of ``before`` has moved in ``after``: pictures x height x width x 2.

    Both pictures are expanded about every pixel; where the second is read at the place moved to so far, half the change
    of b over the mean A is what is left, solved in the least-squares sense over a Gaussian window. The coarsest scale
    comes first, and each gives the next its start.
    """
    height, width = before.shape[1:]
    if scales > 1 and min(height, width) >= 16:
        small = [_along(_along(p, _kernel(1.0, 2), 1), _kernel(1.0, 2), 2)[:, ::2, ::2] for p in (before, after)]
        coarse = 2 * displacement(*small, rounds, window, scales - 1, damping)
        d = np.repeat(np.repeat(coarse, 2, axis=1), 2, axis=2)[:, :height, :width]
    else:
        d = np.zeros((*before.shape, 2))
    (a1, b1), (a2, b2) = expansions(before), expansions(after)
    r0, c0, which = np.arange(height)[None, :, None], np.arange(width)[None, None, :], np.arange(len(before))[:, None, None]
    w = _kernel(window, int(3 * window))
    for _ in range(rounds):
        whole = np.rint(d)
        r, c = (np.clip(o + whole[..., k], 0, n - 1).astype(int) for k, (o, n) in enumerate(((r0, height), (c0, width))))
        moved = np.stack([r - r0, c - c0], axis=-1).astype(float)
        rr, rc, cc = np.moveaxis((a1 + a2[which, r, c]) / 2, -1, 0)
        change = -(b2[which, r, c] - b1) / 2
        y0 = change[..., 0] + rr * moved[..., 0] + rc * moved[..., 1]
        y1 = change[..., 1] + rc * moved[..., 0] + cc * moved[..., 1]
        parts = np.stack([rr * rr + rc * rc, rr * rc + rc * cc, rc * rc + cc * cc, rr * y0 + rc * y1, rc * y0 + cc * y1], axis=-1)
        g00, g01, g11, h0, h1 = np.moveaxis(_along(_along(parts, w, 1), w, 2), -1, 0)
        ease = damping * (g00 + g11).max(axis=(1, 2), keepdims=True) + 1e-12
        g00, g11 = g00 + ease, g11 + ease
        det = g00 * g11 - g01 * g01
        d = np.stack([(g11 * h0 - g01 * h1) / det, (g00 * h1 - g01 * h0) / det], axis=-1)
    return d


def dense_flow(pixels: DataFrame, key: list[str], frame: str, height: int, width: int, grid: tuple[int, int], value: str = "value") -> DataFrame:
    """(key, frame, iy, ix, u, v, speed, dirsin, dircos, div): mean motion in each cell since the frame before, from the dense field.

    u goes along columns, v along rows; div is the mean over a cell of the field's divergence. The first frame, and one
    whose predecessor is missing, has no motion. A pair of frames is one row of work.
    """
    frames = packed(pixels, key, frame, height, width, value)
    prior = frames.select(*key, (F.col(frame) + 1).alias(frame), F.col("pixels").alias("__prior"))
    pairs = joined(frames, prior, [*key, frame])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*key, frame).schema]
    names = ("u", "v", "speed", "dirsin", "dircos", "div")
    ys, xs = bounds(height, grid[0]), bounds(width, grid[1])

    def pooled(field: np.ndarray) -> np.ndarray:
        return np.stack([np.stack([field[:, a:b, c:e].mean(axis=(1, 2)) for c, e in zip(xs, xs[1:], strict=False)], axis=1) for a, b in zip(ys, ys[1:], strict=False)], axis=1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                n, ids = part.num_rows, part.columns[:-2]
                now = matrix(part.column(len(ids))).reshape(n, height, width)
                has = np.array(part.column(len(ids) + 1).is_valid().to_pylist(), dtype=bool)
                d = np.zeros((n, height, width, 2))
                if has.any():
                    before = matrix(part.column(len(ids) + 1).filter(pa.array(has))).reshape(-1, height, width)
                    d[has] = displacement(before, now[has])
                v, u = d[..., 0], d[..., 1]
                div = (np.gradient(v, axis=1) if height > 1 else 0 * v) + (np.gradient(u, axis=2) if width > 1 else 0 * u)
                turn = np.arctan2(v, u)
                fields = [pooled(f) for f in (u, v, np.sqrt(u * u + v * v), np.sin(turn), np.where(has[:, None, None], np.cos(turn), 0.0), div)]
                cells = grid[0] * grid[1]
                take = pa.array(np.repeat(np.arange(n), cells))
                iy, ix = (x.reshape(-1) for x in np.indices(grid))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in ids), pa.array(np.tile(iy, n), pa.int32()), pa.array(np.tile(ix, n), pa.int32()), *(pa.array(f.reshape(-1)) for f in fields)], [*key, frame, "iy", "ix", *names])

    return pairs.select(*key, frame, "pixels", "__prior").mapInArrow(run, ", ".join([*kinds, "iy int", "ix int", *(f"{x} double" for x in names)]))


def stacked(top: DataFrame, below: DataFrame, keys: list[str], height: int, gap: int = 4) -> DataFrame:
    """Rows (keys, row, col, value) of a picture with another one beneath it, ``gap`` rows of nothing between them; frames that one of them lacks go."""
    both = top.select(*keys).distinct().join(below.select(*keys).distinct(), keys)
    low = below.withColumn("row", F.col("row") + height + gap)
    return top.select(*keys, "row", "col", "value").unionByName(low.select(*keys, "row", "col", "value")).join(both, keys, "left_semi")


def unpacked(df: DataFrame, vector: str, keys: list[str], width: int) -> DataFrame:
    """(keys, row, col, value) of packed pictures."""
    return df.select(*keys, F.posexplode(vector).alias("__at", "value")).select(*keys, F.floor(F.col("__at") / width).cast("int").alias("row"), (F.col("__at") % width).cast("int").alias("col"), "value")


def to_bytes(df: DataFrame, keys: list[str], mode: str = "clip") -> DataFrame:
    """Values as whole numbers from 0 to 255: cut off there, or with mode 'scale' stretched from the least to the greatest within ``keys``."""
    if mode == "clip":
        return df.withColumn("value", F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("value")))).cast("int"))
    if mode != "scale":
        raise ValueError(f"unknown mode {mode!r}")
    ends = df.groupBy(*keys).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    return joined(df, ends, keys).withColumn("value", F.coalesce(F.floor(255 * F.try_divide(F.col("value") - F.col("__lo"), F.col("__hi") - F.col("__lo"))), F.lit(0)).cast("int")).drop("__lo", "__hi")


def rebuilt_movie(scored: DataFrame, score: str, found: Components, keys: list[str], k: int, width: int, mode: str = "clip") -> DataFrame:
    """(keys, row, col, value): pictures made again from their first k scores, as bytes; with mode 'scale' over the whole movie."""
    from tracegrid.operators.linalg import rebuilt

    return to_bytes(unpacked(rebuilt(scored, score, found, keys, k), "vector", keys, width), [], mode)


#: name -> extractor (pixels, key, frame, height, width, **settings) -> (key, frame, vector)
VISUAL: dict[str, Callable[..., DataFrame]] = {}


def visual(name: str):
    def keep(f):
        VISUAL[name] = f
        return f

    return keep


def _as_vector(cells: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """(keys, v): each row's cells in a fixed order, value by value."""
    entry = F.struct(*order, *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values])
    lists = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__c"))  # a grid's cells
    return lists.select(*keys, F.concat(*[_pick(v) for v in values]).alias("v"))


def _pick(v: str):
    return F.transform("__c", lambda c: c[v])


@visual("grid")
def grid_block(pixels: DataFrame, key: list[str], frame: str, height: int, width: int, grid: tuple[int, int] = (6, 6), **_) -> DataFrame:
    from tracegrid.operators.raster import cell_statistics

    return _as_vector(cell_statistics(pixels, [*key, frame], height, width, grid), [*key, frame], ["iy", "ix"], ["occ", "mean", "edge"])


@visual("flow")
def flow_block(pixels: DataFrame, key: list[str], frame: str, height: int, width: int, grid: tuple[int, int] = (6, 6), method: str = "lucas_kanade", **_) -> DataFrame:
    from tracegrid.operators.raster import flow

    if method not in ("lucas_kanade", "farneback"):
        raise ValueError(f"unknown method {method!r}")
    cells = (dense_flow if method == "farneback" else flow)(pixels, key, frame, height, width, grid)
    return _as_vector(cells, [*key, frame], ["iy", "ix"], ["speed", "dirsin", "dircos", "div"])


@visual("pixels")
def pixel_block(pixels: DataFrame, key: list[str], frame: str, height: int, width: int, **_) -> DataFrame:
    return packed(pixels, key, frame, height, width).withColumnRenamed("pixels", "v")


def visual_blocks(movies: dict[str, DataFrame], times: DataFrame, frames: DataFrame, key: list[str], frame: str, time: str, at: str, height: int, width: int, specs: dict[str, dict], n_pca: int | None = None, kind: str = "linear", bucket: float | None = None) -> dict[str, DataFrame]:
    """name -> (frames' columns, v): each extractor's vectors of all movies side by side, reduced, and read off at the frames' times.

    movies: side -> pixels (key, frame, row, col, value). times: (key, frame, time) on the movies' clock; frames: (key,
    at) on the other. specs: block -> {"kind": extractor, its settings, "n_pca": components if the block has more}.
    """
    out = {}
    for name, spec in specs.items():
        settings = {k: v for k, v in spec.items() if k not in ("kind", "n_pca")}
        if spec.get("kind", name) not in VISUAL:
            raise KeyError(f"no extractor {spec.get('kind', name)!r}; there are {sorted(VISUAL)}")
        rows = None
        for side in sorted(movies):
            one = VISUAL[spec.get("kind", name)](movies[side], key, frame, height, width, **settings).withColumnRenamed("v", f"__{side}")
            rows = one if rows is None else joined(rows, one, [*key, frame], "inner")
        rows = rows.withColumn("v", F.concat(*[F.col(f"__{side}") for side in sorted(movies)])).select(*key, frame, "v")
        k, first = spec.get("n_pca", n_pca), rows.select(F.size("v")).first()
        width_of = first[0] if first else 0
        if k and width_of > k:
            rows = scores(rows, "v", principal(rows, "v", k), [*key, frame], k).withColumnRenamed("scores", "v")
            width_of = k
        out[name] = read_off(joined(rows, times, [*key, frame], "inner"), frames, key, time, at, "v", width_of, kind, bucket)
    return out


def read_off(rows: DataFrame, frames: DataFrame, key: list[str], time: str, at: str, vector: str, size: int, kind: str = "linear", bucket: float | None = None, ties: list[str] | None = None) -> DataFrame:
    """Vectors of a series read off at other times, place by place, ends held; nothing before there is a sample."""
    wide = rows.select(*key, time, *(ties or []), *[F.get(vector, k).alias(f"__x{k}") for k in range(size)])
    met = interpolated(frames, wide, key, at, time, [f"__x{k}" for k in range(size)], kind, "clamp", bucket, ties)
    return met.select(*frames.columns, F.array(*[f"__x{k}" for k in range(size)]).alias(vector))
