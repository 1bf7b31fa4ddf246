"""Alignment of clocks: as-of joins, interpolation onto a grid, event binning, peri-event windows, intervals.

``spine`` is the side that keeps its rows, ``samples`` the recorded series; both have the session columns ``by``. Sides
are put under one another and looked along, so that no pair of rows is ever made. NULL or NaN times match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.ordered import carried_all, joined


def looked_up(spine: DataFrame, samples: DataFrame, by: list[str], at: str, time: str, values: list[str], sides: dict[str, str], width: float | None = None, ties: list[str] | None = None) -> DataFrame:
    """The spine with a struct of (time, values) of a sample for each entry of sides: name -> 'prev', 'next' or 'after'.

    prev: the last sample at or before ``at``; next: the first at or after it; after: the first strictly later. ties: columns
    that order samples of one time; without them any of those may be taken.
    """
    sample = F.struct(F.col(time).cast("double").alias("t"), *[F.col(v) for v in values])
    row = F.struct(*[F.col(c) for c in spine.columns])
    times = samples.where(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double")))
    tied = {f"__tie{i}": F.col(c) for i, c in enumerate(ties or [])}
    both = spine.select(*by, F.col(at).cast("double").alias("__t"), F.lit(1).alias("__kind"), row.alias("__row")).unionByName(
        times.select(*by, F.col(time).cast("double").alias("__t"), F.lit(0).alias("__kind"), sample.alias("__sample"), *[c.alias(k) for k, c in tied.items()]), allowMissingColumns=True
    )
    order = lambda side: [-F.col("__kind") if side == "next" else F.col("__kind"), *map(F.col, tied)]
    both = carried_all(both, by, "__t", {f"__{name}": ("__sample", order(side), side != "prev") for name, side in sides.items()}, width)
    known = lambda s: F.when(F.col("__t").isNotNull() & ~F.isnan("__t"), F.col(s))
    return both.where("__kind = 1").select("__row.*", *[known(f"__{name}").alias(name) for name in sides])


def lerp(prev: Column, next_: Column, at: Column, value: str) -> Column:
    """Value on the line between two samples; a sample's own time gives its own value."""
    gap = next_["t"] - prev["t"]
    return F.when(gap > 0, prev[value] + (next_[value] - prev[value]) * (at - prev["t"]) / gap).otherwise(prev[value])


def nearer(prev: Column, next_: Column, at: Column, value: str) -> Column:
    """Value of the nearer sample; half-way goes to the earlier one."""
    return F.when(at - prev["t"] <= next_["t"] - at, prev[value]).otherwise(next_[value])


def interpolated(spine: DataFrame, samples: DataFrame, by: list[str], at: str, time: str, values: list[str], kind: str | dict[str, str] = "linear", boundary: str = "clamp", width: float | None = None, ties: list[str] | None = None) -> DataFrame:
    """The spine with ``values`` read off the samples. kind: linear or nearest, for all or by value; boundary: clamp, zero or null."""
    kinds = kind if isinstance(kind, dict) else dict.fromkeys(values, kind)
    if not {kinds[v] for v in values} <= {"linear", "nearest"} or boundary not in ("clamp", "zero", "null"):
        raise ValueError(f"unknown kind {kind!r} or boundary {boundary!r}")
    met = looked_up(spine, samples, by, at, time, values, {"__p": "prev", "__q": "next"}, width, ties)
    p, q = F.col("__p"), F.col("__q")

    def value(v: str) -> Column:
        edge = F.coalesce(p[v], q[v]) if boundary == "clamp" else F.when(p.isNotNull() | q.isNotNull(), F.lit(0.0) if boundary == "zero" else F.lit(None))
        return F.when(p.isNotNull() & q.isNotNull(), (lerp if kinds[v] == "linear" else nearer)(p, q, F.col(at), v)).otherwise(edge)

    return met.withColumns({v: value(v) for v in values}).drop("__p", "__q")


def nearest(spine: DataFrame, samples: DataFrame, by: list[str], at: str, time: str, values: list[str], width: float | None = None) -> DataFrame:
    """The spine with the values of the nearest sample; of two as near the earlier one."""
    return interpolated(spine, samples, by, at, time, values, "nearest", "clamp", width)


def next_sample(events: DataFrame, samples: DataFrame, by: list[str], at: str, time: str, value: str, trailing: str = "keep", width: float | None = None) -> DataFrame:
    """Events with ``value`` of the first sample strictly later. After the last sample: that one (keep), or the event goes (drop)."""
    if trailing not in ("keep", "drop"):
        raise ValueError("trailing is 'keep' or 'drop'")
    sides = {"__n": "after"} | ({"__l": "prev"} if trailing == "keep" else {})
    met = looked_up(events, samples, by, at, time, [value], sides, width)
    found = F.coalesce(F.col("__n"), F.col("__l")) if trailing == "keep" else F.col("__n")
    # With no later sample the last one at or before the event is the series' last.
    return met.withColumn("__f", found).where("__f is not null").withColumn(value, F.col("__f")[value]).drop("__n", "__l", "__f")


def binned(events: DataFrame, samples: DataFrame, by: list[str], at: str, time: str, frame: str, counts: dict[str, Column], trailing: str = "keep", width: float | None = None) -> DataFrame:
    """Every sample with the number of events that fall to it, for each named condition."""
    hit = next_sample(events, samples, by, at, time, frame, trailing, width)
    n = hit.groupBy(*by, frame).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    return joined(samples, n, [*by, frame]).na.fill(0, list(counts))


def around(events: DataFrame, anchors: DataFrame, by: list[str], at: str, anchor: str, lo: float, hi: float) -> DataFrame:
    """Pairs (anchor, event) with lo < event - anchor < hi. A band join: both sides meet in buckets as wide as the band."""
    width = float(hi - lo)
    left = anchors.withColumn("__b", F.explode(F.sequence(F.floor((F.col(anchor) + lo) / width), F.floor((F.col(anchor) + hi) / width))))
    right = events.withColumn("__b", F.floor(F.col(at) / width))
    gap = F.col(at) - F.col(anchor)
    right = right.withColumnsRenamed({k: f"__e_{k}" for k in by})
    on = [F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in by]
    met = left.join(right.withColumnRenamed("__b", "__c"), [*on, F.col("__b") == F.col("__c")]).where((gap > lo) & (gap < hi))
    return met.withColumn("lag", gap).drop("__b", "__c", *[f"__e_{k}" for k in by])


def kept_frames(cuts: DataFrame, start: str, end: str, frame: str = "frame") -> DataFrame:
    """Frames (from 0) of intervals that count from 1 with both ends included."""
    return cuts.withColumn(frame, F.explode(F.sequence(F.col(start) - 1, F.col(end) - 1)))
