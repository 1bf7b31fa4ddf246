"""Ordered series without one task for a whole session.

A window partitioned by session sorts all of a session in one task, which a session with a third of all rows does not
survive. Here a series is cut into chunks of rows (or buckets of time); what a row needs from beyond its chunk comes
either as copies of the neighbouring rows (``windowed``) or as one summary row for each chunk (``carried``,
``positions``, ``running``), and only those summaries are ordered over a whole session.

Rows keep their other columns; names beginning with two underscores are the module's own. NULL keys form a session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a series that one chunk holds besides its borders.
CHUNK = 1 << 16

#: Rows of many buckets that one task puts in order.
PART = 1 << 18


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL; the right side's keys go. Without keys the right side is one row."""
    if not keys:
        return left.join(F.broadcast(right))
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"__r_{k}" for k in keys])


def bucketed(df: DataFrame, time: str, width: float | None) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(time) / F.lit(float(width))).cast("bigint") if width else F.lit(0).cast("bigint"))


def positions(df: DataFrame, by: list[str], time: str, order: list[str], out: str = "pos", width: float | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... by time, then by ``order``, within each session. width: seconds of a bucket."""
    rows = bucketed(df, time, width)
    row = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(time, *order)) - 1
    if not width:
        return rows.withColumn(out, row.cast("bigint")).drop("__b")
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = counts.select(*by, "__b", (F.sum("__n").over(Window.partitionBy(*by).orderBy("__b")) - F.col("__n")).alias("__before"))
    return joined(rows.withColumn("__row", row), before, [*by, "__b"]).withColumn(out, (F.col("__row") + F.col("__before")).cast("bigint")).drop("__b", "__row", "__before")


def ranked(df: DataFrame, value: str, order: list, out: str, parts: int = 64) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... of all rows by a number, then by ``order``, NULL first. Rows are ordered within ranges of the number.

    Approximate cuts make the ranges, so that as many rows fall in each as their values allow.
    """
    cuts = df.select(F.percentile_approx(F.col(value).cast("double"), [k / parts for k in range(1, parts)], 10 * parts)).collect()[0][0] or []
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(value))) if cuts else F.lit(0)
    rows = df.withColumn("__p", F.coalesce(F.when(F.col(value).isNotNull(), at), F.lit(-1)))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row for each range
    row = F.row_number().over(Window.partitionBy("__p").orderBy(value, *order)) - 1
    return rows.withColumn("__row", row).join(F.broadcast(before), "__p").withColumn(out, (F.col("__row") + F.col("__before")).cast("bigint")).drop("__p", "__row", "__before")


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df in parts by some columns, as many as let none hold or make much more than ``PART`` of so many rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART)), *by)


def carried(rows: DataFrame, by: list[str], time: str, order: list[Column], value: str, out: str, *, forward: bool = False, width: float | None = None) -> DataFrame:
    """Add ``out``: the last value that is not NULL at or before each row; with ``forward`` the first at or after it."""
    return carried_all(rows, by, time, {out: (value, order, forward)}, width)


def carried_all(rows: DataFrame, by: list[str], time: str, wanted: dict[str, tuple[str, list[Column], bool]], width: float | None = None) -> DataFrame:
    """``carried`` for several columns: out -> (value, order, forward). The rows are read a few times, however many there are."""
    rows = bucketed(rows, time, width)
    # Forward looks back along the opposite order: a frame that grows costs one step a row, one that shrinks a whole pass.
    turned = lambda order, forward: [c.desc() if forward else c for c in (F.col(time), *order)]
    if not width:
        near = {o: F.last(v, True).over(Window.partitionBy(*by, "__b").orderBy(*turned(order, forward)).rowsBetween(Window.unboundedPreceding, 0)) for o, (v, order, forward) in wanted.items()}
        return rows.withColumns(near).drop("__b")
    # Of each bucket the value nearest to its border; rows without a value have no rank, and those without any aren't sorted.
    rank = lambda v, order: F.when(F.col(v).isNotNull(), F.struct(F.col(time), *order))
    known = rows.where(F.coalesce(*[F.when(F.col(v).isNotNull(), True) for v, _, _ in wanted.values()]))
    heads = known.groupBy(*by, "__b").agg(*[(F.min_by if forward else F.max_by)(F.col(v), rank(v, order)).alias(f"__head_{o}") for o, (v, order, forward) in wanted.items()])
    heads = joined(rows.select(*by, "__b").distinct(), heads, [*by, "__b"])
    over = {forward: Window.partitionBy(*by).orderBy(F.col("__b").desc() if forward else "__b").rowsBetween(Window.unboundedPreceding, -1) for forward in (False, True)}
    told = heads.select(*by, "__b", *[F.last(f"__head_{o}", True).over(over[forward]).alias(f"__beyond_{o}") for o, (_, _, forward) in wanted.items()])
    # What lies beyond a bucket is a row before its first, along either order.
    both = rows.withColumn("__own", F.lit(True)).unionByName(told.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    both = dealt(both, rows.count(), *by, "__b")
    value = lambda o, v: F.when(F.col("__own"), F.col(v)).otherwise(F.col(f"__beyond_{o}"))
    near = {o: F.last(value(o, v), True).over(Window.partitionBy(*by, "__b").orderBy("__own", *turned(order, forward)).rowsBetween(Window.unboundedPreceding, 0)) for o, (v, order, forward) in wanted.items()}
    return both.withColumns(near).where("__own").drop("__b", "__own", *[f"__beyond_{o}" for o in wanted])


def windowed(df: DataFrame, by: list[str], pos: str, made: dict[str, Callable[[WindowSpec], Column]], before: int = 1, after: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Add columns that look at most ``before`` rows back and ``after`` ahead. pos: dense positions from 0.

    Each row goes to its chunk and, if it lies near a border, to the chunk beyond it as well.
    """
    spec = Window.partitionBy(*by, "__chunk").orderBy(pos)
    rows = bordered(df, pos, before, after, chunk).withColumns({name: f(spec) for name, f in made.items()})
    return rows.where(F.col("__chunk") == F.floor(F.col(pos) / chunk)).drop("__chunk")


def bordered(df: DataFrame, pos: str, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Each row with ``__chunk``, its own chunk's number, and once more for each other chunk whose rows look at it."""
    if before > chunk or after > chunk:
        raise ValueError("a chunk must be as long as what its rows look at")
    own, k = F.floor(F.col(pos) / chunk), F.col(pos) % chunk
    none = F.lit(None).cast("bigint")
    ahead = F.when(k >= chunk - before, own + 1) if before else none
    back = F.when((k < after) & (own > 0), own - 1) if after else none
    return df.withColumn("__chunk", F.explode(F.array_compact(F.array(own, ahead, back))))


def running(df: DataFrame, by: list[str], pos: str, sums: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Add running sums, the row itself included; NULL counts as nothing."""
    rows = df.withColumns({f"__v_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}).withColumn("__chunk", F.floor(F.col(pos) / chunk))
    parts = rows.groupBy(*by, "__chunk").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums])
    over = Window.partitionBy(*by).orderBy("__chunk")
    parts = parts.select(*by, "__chunk", *[(F.sum(f"__s_{k}").over(over) - F.col(f"__s_{k}")).alias(f"__o_{k}") for k in sums])
    inside = Window.partitionBy(*by, "__chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__i_{k}": F.sum(f"__v_{k}").over(inside) for k in sums})
    rows = joined(rows, parts, [*by, "__chunk"])
    return rows.withColumns({k: F.col(f"__i_{k}") + F.col(f"__o_{k}") for k in sums}).drop("__chunk", *[f"__{x}_{k}" for k in sums for x in "vsoi"])
