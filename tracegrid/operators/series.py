"""Filters and differences along the frames of a session or cell. Positions are dense, from 0 (ordered.positions)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracegrid.functions.columns import quotient
from tracegrid.operators.ordered import CHUNK, bordered, joined, running, windowed

#: Half-widths of the three Gaussian kernels, in frames.
REACH = {"plain": lambda s: 3 * math.ceil(s), "even": lambda s: int(4 * s + 0.5), "zeroed": lambda s: math.ceil(4 * s)}

#: What stands for rows beyond a series' ends.
EDGES = ("zero", "nearest", "reflect")


def taps(kind: str, sigma: float) -> list[float]:
    """Weights of a Gaussian: 'plain' is not divided by its sum; 'even' and 'zeroed' are, and differ in reach."""
    h = REACH[kind](sigma)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-h, h + 1)]
    total = 1.0 if kind == "plain" else sum(w)
    return [x / total for x in w]


def filtered(df: DataFrame, by: list[str], pos: str, columns: dict[str, str], weights: list[float], edge: str = "zero", chunk: int = CHUNK) -> DataFrame:
    """Add each named column: a weighted sum over the rows around. edge: zero, nearest or reflect (the border row twice).

    NULL values count as zero. A reflected series must be as long as the kernel's half-width, else the result is NULL.
    """
    h = len(weights) // 2
    if edge not in EDGES:
        raise ValueError(f"unknown edge {edge!r}")
    if h == 0:
        return df.withColumns({out: F.col(x) * weights[0] for out, x in columns.items()})
    names = {out: (f"__x{i}", f"__f{i}") for i, out in enumerate(columns)}
    rows = bordered(df, pos, h, h, chunk).withColumns({names[out][0]: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for out, x in columns.items()})
    # A task's rows are in order by the window; row 1 begins a chunk.
    rows = rows.withColumn("__row", F.row_number().over(Window.partitionBy(*by, "__chunk").orderBy(pos)))

    def run(batches):
        for some in whole_chunks(batches):
            first = some["__row"].to_numpy() == 1
            for x, f in names.values():
                value, known = weighted(some[x].to_numpy(), first, weights, edge)
                some = some.append_column(f, pa.array(value, pa.float64(), mask=~known))
            yield from some.to_batches()

    made = [StructField(f, DoubleType()) for _, f in names.values()]
    rows = rows.mapInArrow(run, StructType([*(StructField(c.name, c.dataType) for c in rows.schema), *made]))
    rows = rows.where(F.col("__chunk") == F.floor(F.col(pos) / chunk)).withColumns({out: F.col(f) for out, (_, f) in names.items()})
    return rows.drop("__chunk", "__row", *[c for pair in names.values() for c in pair])


def whole_chunks(batches):
    """Arrow tables of whole chunks, in which ``__row`` counts from 1."""
    held: list = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("__row").to_numpy() == 1)
        if not len(starts):
            held.append(batch)
            continue
        held.append(batch.slice(0, starts[-1]))
        if any(b.num_rows for b in held):
            yield pa.Table.from_batches(held)
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held)


def weighted(x: np.ndarray, first: np.ndarray, weights: list[float], edge: str) -> tuple[np.ndarray, np.ndarray]:
    """(weighted sums, whether known) of chunks that lie one behind the other, terms added from the earliest row on."""
    h = len(weights) // 2
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(x)))
    of = np.cumsum(first) - 1
    # Each chunk gets h places on both sides, which hold what stands for rows beyond it.
    at = np.arange(len(x)) + h + 2 * h * of
    wide = np.zeros(len(x) + 2 * h * len(start))
    wide[at] = x
    beyond = np.arange(h)
    low, high = at[start] - 1, at[start + size - 1] + 1
    known = np.ones(len(x), dtype=bool)
    if edge != "zero":
        step = np.zeros((len(start), h), dtype=np.int64) if edge == "nearest" else np.minimum(beyond[None, :], size[:, None] - 1)
        wide[low[:, None] - beyond] = x[start[:, None] + step]
        wide[high[:, None] + beyond] = x[(start + size - 1)[:, None] - step]
    if edge == "reflect":
        k = np.arange(len(x)) - start[of]
        known = np.maximum(h - k, h - (size[of] - 1 - k)) <= size[of]
    n = len(wide) - 2 * h
    total = np.zeros(n)
    for j, w in enumerate(weights):
        total += w * wide[j : j + n]
    return total[at - h], known


def smoothed(df: DataFrame, by: list[str], pos: str, columns: dict[str, str], sigma: float, kind: str = "plain", edge: str = "zero", chunk: int = CHUNK) -> DataFrame:
    """Gaussian smoothing; sigma 0 leaves the series as it is."""
    if not sigma:
        return df.withColumns({out: F.col(x) for out, x in columns.items()})
    return filtered(df, by, pos, columns, taps(kind, sigma), edge, chunk)


def detrended(df: DataFrame, by: list[str], pos: str, value: str, out: str, sigma: float, chunk: int = CHUNK) -> DataFrame:
    """value minus its smoothed self, NULLs left out of the smoothing and kept; under 3 values: unchanged."""
    return detrended_all(df, by, pos, {out: (value, sigma)}, chunk)


def detrended_all(df: DataFrame, by: list[str], pos: str, wanted: dict[str, tuple[str, float]], chunk: int = CHUNK) -> DataFrame:
    """``detrended`` for several columns: out -> (value, sigma), a pass for each sigma."""
    place = {v: i for i, v in enumerate(dict.fromkeys(v for v, _ in wanted.values()))}
    counts = df.groupBy(*by).agg(*[F.count(v).alias(f"__n{i}") for v, i in place.items()])
    rows = df.withColumns({f"__m{i}": F.when(F.col(v).isNotNull(), 1.0).otherwise(0.0) for v, i in place.items()} | {f"__y{i}": F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v, i in place.items()})
    sigmas = {s: k for k, s in enumerate(dict.fromkeys(s for _, s in wanted.values()))}
    for s, k in sigmas.items():
        at = [place[v] for v in dict.fromkeys(v for v, own in wanted.values() if own == s)]
        rows = smoothed(rows, by, pos, {f"__g{c}{i}_{k}": f"__{c}{i}" for i in at for c in "ym"}, s, "even", "nearest", chunk)
    rows = joined(rows, counts, by)
    flat = {}
    for out, (v, s) in wanted.items():
        gy, gm = (F.col(f"__g{c}{place[v]}_{sigmas[s]}") for c in "ym")
        trend = F.when(gm > 1e-6, gy / gm).otherwise(0.0)
        flat[out] = F.when(F.col(f"__n{place[v]}") < 3, F.col(v).cast("double")).otherwise(F.col(v) - trend)
    own = [f"__{c}{i}" for i in place.values() for c in "myn"] + [f"__g{c}{i}_{k}" for i in place.values() for c in "ym" for k in sigmas.values()]
    return rows.withColumns(flat).drop(*own)


def detrend_sigma(block: str, spec, seconds: float | None, fs: float) -> float | None:
    """Frames of smoothing for a block. spec None: seconds for all; dict: its own seconds or none; list: seconds for those listed."""
    if isinstance(spec, dict):
        own = spec.get(block)
    else:
        own = seconds if spec is None or block in spec else None
    return own * fs if own else None


def difference(df: DataFrame, by: list[str], pos: str, value: str, out: str, first: str = "null", chunk: int = CHUNK) -> DataFrame:
    """Change since the row before; the first row's is NULL, or with first='value' its own value."""
    start = F.lit(0.0) if first == "value" else F.lit(None).cast("double")
    return windowed(df, by, pos, {out: lambda w: F.col(value) - F.when(F.col(pos) == 0, start).otherwise(F.lag(value).over(w))}, 1, 0, chunk)


def rectified_slope(df: DataFrame, by: list[str], pos: str, value: str, out: str, sigma: float = 1.0, rectify: bool = True, normalise: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Smoothed difference, negative parts cut off, minus its mean, divided by the maximum of what is left."""
    rows = smoothed(difference(df, by, pos, value, "__d", "value", chunk), by, pos, {out: "__d"}, sigma, chunk=chunk).drop("__d")
    if rectify:
        rows = rows.withColumn(out, F.greatest(F.col(out), F.lit(0.0)))
    if normalise:
        stats = rows.groupBy(*by).agg(F.avg(out).alias("__a"), F.max(out).alias("__x"))
        rows = joined(rows, stats, by).withColumn(out, F.try_divide(F.col(out) - F.col("__a"), F.col("__x") - F.col("__a"))).drop("__a", "__x")
    return rows


def gradient(df: DataFrame, by: list[str], pos: str, value: str, out: str, time: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Central differences, of second order for uneven times as well; one-sided at both ends.

    A row at the time of one that it is compared with has no finite slope: infinite or NaN, as the division by 0 gives it.
    """

    def made(w) -> Column:
        y, a, b = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
        hs = F.col(time) - F.lag(time).over(w) if time else F.when(a.isNotNull(), 1.0)
        hd = F.lead(time).over(w) - F.col(time) if time else F.when(b.isNotNull(), 1.0)
        inner = quotient(hs * hs * b + (hd * hd - hs * hs) * y - hd * hd * a, hs * hd * (hd + hs))
        return F.when(hs.isNull(), quotient(b - y, hd)).when(hd.isNull(), quotient(y - a, hs)).otherwise(inner)

    return windowed(df, by, pos, {out: made}, 1, 1, chunk)


def unwrapped(df: DataFrame, by: list[str], pos: str, angle: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Angles with whole turns added so that no step exceeds half a turn; a step of exactly half a turn keeps its sign."""
    two = 2 * math.pi

    def turn(w) -> Column:
        d = F.col(angle) - F.lag(angle).over(w)
        back = d + math.pi
        m = back - two * F.floor(back / two) - math.pi
        m = F.when((m == -math.pi) & (d > 0), F.lit(math.pi)).otherwise(m)
        return F.when(F.abs(d) < math.pi, F.lit(0.0)).otherwise(m - d)

    rows = windowed(df, by, pos, {"__turn": turn}, 1, 0, chunk)
    return running(rows, by, pos, {"__sum": F.col("__turn")}, chunk).withColumn(out, F.col(angle) + F.col("__sum")).drop("__turn", "__sum")


def rising(df: DataFrame, by: list[str], pos: str, value: str, threshold, out: str, chunk: int = CHUNK) -> DataFrame:
    """True where the value has just come to exceed the threshold; never on the first row."""
    above = F.coalesce(F.col(value) > threshold, F.lit(False))
    return windowed(df, by, pos, {out: lambda w: above & ~F.coalesce(F.lag(above).over(w), F.lit(True))}, 1, 0, chunk)


def runs(df: DataFrame, by: list[str], pos: str, label: str, chunk: int = CHUNK) -> DataFrame:
    """(by, label, run, first, last, length) of each stretch of rows with the same label."""
    rows = windowed(df, by, pos, {"__new": lambda w: F.when((F.col(pos) > 0) & F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)}, 1, 0, chunk)
    rows = running(rows, by, pos, {"run": F.col("__new")}, chunk)
    return rows.groupBy(*by, label, "run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("length"))


def triggered(df: DataFrame, anchors: DataFrame, by: list[str], pos: str, before: int, after: int, length: DataFrame | None = None) -> DataFrame:
    """(anchor, rel, columns): rows from ``before`` before each anchor to ``after`` after it, the end excluded.

    length: (by, n); with it only windows that lie wholly inside stay, by the strict rule anchor > before and anchor + after < n.
    """
    spots = anchors.select(*by, F.col(pos).alias("anchor"))
    if length is not None:
        spots = joined(spots, length, by, "inner").where((F.col("anchor") > before) & (F.col("anchor") + after < F.col("n"))).drop("n")
    asked = spots.withColumn("rel", F.explode(F.sequence(F.lit(-before), F.lit(after - 1)))).withColumn(pos, F.col("anchor") + F.col("rel"))
    return joined(asked, df, [*by, pos], "inner")


def median_filtered(df: DataFrame, by: list[str], pos: str, value: str, out: str, size: int, chunk: int = CHUNK) -> DataFrame:
    """Median of ``size`` rows around, the border reflected. An even size looks one row further back."""
    back, ahead = size // 2, size - 1 - size // 2

    def made(w) -> Column:
        seen = F.collect_list(F.col(value)).over(w.rowsBetween(-back, ahead))
        left = F.greatest(F.lit(back) - F.col(pos).cast("int"), F.lit(0))
        right = F.lit(size) - left - F.size(seen)
        full = F.sort_array(F.concat(F.reverse(F.slice(seen, F.lit(1), left)), seen, F.reverse(F.slice(seen, F.size(seen) - right + 1, right))))
        return F.element_at(full, size // 2 + 1)

    return windowed(df, by, pos, {out: made}, back, max(1, ahead), chunk)


def sampling_rate(df: DataFrame, by: list[str], pos: str, time: str, default: float = 60.0) -> DataFrame:
    """(by, fs): one over the median step; ``default`` where there is no step or the median is 0."""
    from tracegrid.operators.stats import quantiles

    mid = quantiles(difference(df, by, pos, time, "__dt"), by, "__dt", [0.5])
    rows = joined(df.select(*by).distinct(), mid, by)
    return rows.select(*by, F.coalesce(F.try_divide(F.lit(1.0), F.col("q")), F.lit(default)).alias("fs"))


def lagged_products(pairs: DataFrame, by: list[str], pos: str, a: str, b: str, lags: int, n: str) -> DataFrame:
    """(by, lag, product): sum of a[k] * b[k + lag], positions taken round the series' length ``n``."""
    left = pairs.where(F.col(a) != 0).select(*by, F.col(a).alias("__a"), F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"), F.pmod(F.col(pos) + F.col("lag"), F.col(n)).alias(pos))
    met = joined(left, pairs.where(F.col(b) != 0).select(*by, pos, F.col(b).alias("__b")), [*by, pos], "inner")
    return met.groupBy(*by, "lag").agg(F.sum(F.col("__a") * F.col("__b")).alias("product"))


def movement(df: DataFrame, by: list[str], pos: str, x: str, y: str, z: str, heading: str, chunk: int = CHUNK) -> DataFrame:
    """Add d_dist, the distance since the row before, and d_phi, the change of heading in (-pi, pi]."""
    step = lambda c, w: F.col(c) - F.lag(c).over(w)
    made = {
        "d_dist": lambda w: F.sqrt(sum((F.pow(step(c, w), 2) for c in (y, z)), F.pow(step(x, w), 2))),
        "d_phi": lambda w: F.atan2(F.sin(step(heading, w)), F.cos(step(heading, w))),
    }
    return windowed(df, by, pos, made, 1, 0, chunk)


def event_rates(df: DataFrame, by: list[str], pos: str, time: str, a: str, b: str, dt: str, chunk: int = CHUNK) -> DataFrame:
    """Running counts of two events, their ratio and the rate of the second; elapsed time on the first row is one step."""
    rows = running(df, by, pos, {f"{a}_cum": F.col(a), f"{b}_cum": F.col(b)}, chunk)
    rows = joined(rows, rows.groupBy(*by).agg(F.min(time).alias("__t0")), by)
    elapsed = F.when(F.col(pos) == 0, F.col(dt)).otherwise(F.col(time) - F.col("__t0"))
    return rows.withColumns({"ratio": (F.col(f"{a}_cum") + 1e-5) / (F.col(f"{b}_cum") + 1e-5), "rate": F.try_divide(F.col(f"{b}_cum"), elapsed)}).drop("__t0")


def rezeroed(df: DataFrame, by: list[str], pos: str, value: str, out: str) -> DataFrame:
    """value minus the series' first."""
    first = df.groupBy(*by).agg(F.min_by(value, pos).alias("__first"))
    return joined(df, first, by).withColumn(out, F.col(value) - F.col("__first")).drop("__first")


def peak(df: DataFrame, by: list[str], pos: str, value: str, size: int = 3) -> DataFrame:
    """(by, at, peak): position of the maximum and the mean of ``size`` rows around it, moved inside the series."""
    top = df.groupBy(*by).agg(F.max_by(pos, F.struct(F.col(value), -F.col(pos))).alias("at"), F.max(pos).alias("__end"))
    start = F.greatest(F.lit(0), F.least(F.col("at") - size // 2, F.col("__end") - size + 1))
    met = joined(df, top.withColumn("__from", start), by, "inner")
    return met.where(F.col(pos).between(F.col("__from"), F.col("__from") + size - 1)).groupBy(*by, "at").agg(F.avg(value).alias("peak"))


def shifted(df: DataFrame, by: list[str], pos: str, shift: Column, n: str) -> DataFrame:
    """Positions moved round the series' length ``n``."""
    return df.withColumn(pos, F.pmod(F.col(pos) + shift, F.col(n)))


def order_window(by: list[str], *order):
    return Window.partitionBy(*by).orderBy(*order)
