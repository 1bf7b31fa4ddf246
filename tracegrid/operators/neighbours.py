"""Exact nearest rows by cells about pivots.

Rows belong to the nearest of about sqrt(n) pivots, or so few that a cell fills a block. Two bounds of the triangle inequality, the distance to a cell's ring and
to the plane between two pivots, tell which cells can hold one of a question's k nearest. A question first visits the cells
nearest to it that hold k rows it may use; the k-th distance found there decides which others it still has to visit, so
no cell is left out that could matter, and few are visited where rows are spread along few dimensions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tracegrid.operators.settle import settled

#: Most pivots: with vectors of 64 doubles, 2 MB that every task gets.
PIVOTS = 4096

#: Rows of a block, 8 MB of 64 doubles. Where bounds leave nothing out a question is sent to every block, so that what is
#: shuffled falls with this.
BLOCK = 1 << 14

#: Equal questions are asked at most this many times, so that one vector on many rows is no hot key when answers go back.
COPIES = 32


class Cells:
    """Pivots, and for each segment of positions how many rows each cell has and the radii they lie between."""

    def __init__(self, pivots: np.ndarray):
        self.middle = pivots.mean(axis=0)
        self.pivots = pivots - self.middle
        self.apart = np.sqrt(np.maximum(self._squares(self.pivots), 0))
        self.counts = self.low = self.high = self.blocks = None
        self.reach = 0.0

    def _squares(self, v: np.ndarray) -> np.ndarray:
        return (v**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * v @ self.pivots.T

    def assigned(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, radius, norm) of each vector."""
        v = v - self.middle
        cell = self._squares(v).argmin(axis=1)
        return cell, np.sqrt(((v - self.pivots[cell]) ** 2).sum(1)), np.sqrt((v**2).sum(1))

    def holding(self, found: list, segments: int, block: int) -> Cells:
        """The same with what the cells hold, from rows of (cell, segment, count, least and greatest radius, greatest norm)."""
        shape = (segments, len(self.pivots))
        self.counts, self.low, self.high = np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
        for c, s, count, low, high, norm in found:
            self.counts[s, c], self.low[s, c], self.high[s, c] = count, low, high
            self.reach = max(self.reach, norm)
        self.blocks = np.maximum(1, -(-self.counts.sum(axis=0) // block))
        return self

    def bounds(self, v: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, distance to the pivot, least possible distance) of each cell's rows in open segments, for each question.

        Squared distances carry an allowance for rounding, so the last is never above the true least distance.
        """
        v = v - self.middle
        squares = self._squares(v)
        slack = 1e-12 * (np.sqrt((v**2).sum(1))[:, None] + self.reach) ** 2
        own = squares.argmin(axis=1)
        count = open_.astype(np.int64) @ self.counts
        low = np.stack([np.where(o[:, None], self.low, np.inf).min(axis=0) for o in open_])
        high = np.stack([np.where(o[:, None], self.high, -np.inf).max(axis=0) for o in open_])
        ring = np.maximum(np.sqrt(np.maximum(squares - slack, 0)) - high, low - np.sqrt(np.maximum(squares, 0) + slack))
        gap = self.apart[own]
        plane = np.where(gap > 0, (squares - squares[np.arange(len(v)), own][:, None] - 2 * slack) / np.where(gap > 0, 2 * gap, 1), 0)
        return count, squares, np.maximum(np.maximum(ring, plane), 0)


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _settled_cells(rows: DataFrame, cells: Cells, block: int) -> DataFrame:
    import pyarrow as pa

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cell, radius, norm = cells.assigned(_vectors(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(norm)], [*batch.schema.names, "c", "r", "m"])

    return settled(rows.mapInArrow(assign, StructType([*rows.schema.fields, StructField("c", IntegerType()), StructField("r", DoubleType()), StructField("m", DoubleType())])))


def _met(asked: DataFrame, packed: DataFrame, barred: np.ndarray, k: int) -> DataFrame:
    """(p, t, y, d): of each block that a question visits, the k nearest rows it may use that are no farther than its bound."""
    import pyarrow as pa

    def look(batches):
        for batch in batches:
            for asks, known in zip(batch.column("asks"), batch.column("rows"), strict=True):
                a, t = asks.values, known.values
                ap, af, ad = (a.field(f).to_numpy() for f in ("p", "f", "d"))
                tp, ty = (t.field(f).to_numpy() for f in ("p", "y"))
                av, tv = _vectors(a.field("v")), _vectors(t.field("v"))
                av, tv = av - tv.mean(axis=0), tv - tv.mean(axis=0)
                for at in range(0, len(ap), 128):
                    q, f = av[at : at + 128], af[at : at + 128]
                    near = (q**2).sum(1)[:, None] + (tv**2).sum(1)[None, :] - 2 * q @ tv.T
                    slack = 1e-12 * ((q**2).sum(1)[:, None] + (tv**2).sum(1)[None, :])
                    near[(tp[None, :] >= barred[f, 0][:, None]) & (tp[None, :] < barred[f, 1][:, None])] = np.inf
                    fits = np.isfinite(near) & (near - slack <= ((ad[at : at + 128] * (1 + 1e-9)) ** 2)[:, None])
                    many = np.flatnonzero(np.count_nonzero(fits, axis=1) > k)  # of these the k-th of the block is a closer bound
                    if len(many):
                        top = np.partition(near[many] + slack[many], k - 1, axis=1)[:, k - 1]
                        fits[many] &= near[many] - slack[many] <= top[:, None]
                    i, j = np.nonzero(fits)
                    exact = np.sqrt(((_vectors(a.field("v"))[at + i] - _vectors(t.field("v"))[j]) ** 2).sum(1))
                    order = np.lexsort((tp[j], exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j, exact = i[keep], j[keep], exact[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ap[at + i]), pa.array(tp[j]), pa.array(ty[j]), pa.array(exact)], ["p", "t", "y", "d"])

    found = asked.join(packed, ["c", "b"]).select("asks", "rows").mapInArrow(look, "p bigint, t bigint, y double, d double")
    return found.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("d", "t"))).where(F.col("i") <= k)


def _routed(questions: DataFrame, cells: Cells, open_: np.ndarray, k: int, block: int, first: bool) -> DataFrame:
    """(c, b, asks): questions in packs of at most ``block`` for each block of rows they visit.

    The first visit goes to the nearest cells that hold k rows between them; the second to every other whose bound allows it.
    """
    import pyarrow as pa

    kind = pa.struct([("p", pa.int64()), ("f", pa.int32()), ("d", pa.float64()), ("v", pa.list_(pa.float64()))])

    def visits(v: np.ndarray, f: np.ndarray, d: np.ndarray) -> np.ndarray:
        count, squares, least = cells.bounds(v, open_[f])
        order = np.argsort(np.where(count > 0, squares, np.inf), axis=1, kind="stable")
        sofar = np.cumsum(np.take_along_axis(count, order, axis=1), axis=1)
        early = np.zeros(count.shape, dtype=bool)
        np.put_along_axis(early, order, sofar - np.take_along_axis(count, order, axis=1) < k, axis=1)
        return (early if first else least <= d[:, None] * (1 + 1e-9)) & (count > 0)

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, f, p, d = _vectors(batch.column("v")), batch.column("f").to_numpy(), batch.column("p"), batch.column("d").to_numpy()
            for at in range(0, len(f), block):
                part = slice(at, at + block)
                go = visits(v[part], f[part], d[part])
                if not first:
                    for i, seen in enumerate(batch.column("seen").to_pylist()[part]):
                        go[i, seen] = False
                asks = pa.StructArray.from_arrays([p.slice(at, block), batch.column("f").slice(at, block), batch.column("d").slice(at, block), batch.column("v").slice(at, block).cast(kind.field("v").type)], fields=list(kind))
                for c in np.flatnonzero(go.any(axis=0)):
                    pack = asks.take(pa.array(np.flatnonzero(go[:, c])))
                    one = pa.ListArray.from_arrays(pa.array([0, len(pack)], pa.int32()), pack)
                    for b in range(cells.blocks[c]):
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([b], pa.int32()), one], ["c", "b", "asks"])

    return questions.mapInArrow(route, "c int, b int, asks array<struct<p: bigint, f: int, d: double, v: array<double>>>")


def nearest_allowed(rows: DataFrame, barred: list[tuple[int, int]], k: int, n: int, block: int = BLOCK) -> DataFrame:
    """(p, t, y, d): the k rows t nearest to each row p that lie outside the positions [low, high) barred to p's fold f.

    ``rows``: p bigint (unique), f int, y double, v array<double> of one length. Rows with a NULL, or a component that is
    NULL or not finite, take no part; components' sizes stay below 1e150. Of equal distances the lower position counts. Of rows with equal vectors between
    the same two edges only the first k can count, and equal questions of a fold are asked ``COPIES`` times at most.
    A question with fewer rows to use has them all; without any it has no row.
    """
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = settled(rows.where(F.col("p").isNotNull() & F.col("f").isNotNull() & F.col("y").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("v") > 0)))
    wanted = int(min(PIVOTS, max(1, min(math.ceil(math.sqrt(n)), n // block))))
    pivots = np.unique(np.array([r.v for r in rows.orderBy(F.xxhash64("p"), "p").select("v").limit(wanted).collect()], dtype=float), axis=0)
    if not len(pivots):
        return rows.select("p", F.col("p").alias("t"), "y", F.lit(0.0).alias("d"))
    edges = sorted({e for pair in barred for e in pair})
    starts = np.array([-np.inf, *edges])
    open_ = np.array([[not (low <= s < high) for s in starts] for low, high in barred])
    segment = F.lit(0)
    for e in edges:
        segment = segment + (F.col("p") >= F.lit(e)).cast("int")
    first = Window.partitionBy("v", "s").orderBy("p")
    cells = Cells(pivots)
    known = _settled_cells(rows.select("p", "y", "v", segment.alias("s")).withColumn("i", F.row_number().over(first)).where(F.col("i") <= k).drop("i"), cells, block)
    held = known.groupBy("c", "s").agg(F.count("*"), F.min("r"), F.max("r"), F.max("m")).collect()  # at most PIVOTS x segments rows
    cells.holding([tuple(h) for h in held], len(starts), block)
    blocks = F.element_at(F.array(*[F.lit(int(b)) for b in cells.blocks]), F.col("c") + 1)
    packed = known.withColumn("b", F.pmod(F.xxhash64("p"), blocks).cast("int")).groupBy("c", "b").agg(F.collect_list(F.struct("p", "y", "v")).alias("rows"))  # about ``block`` rows each
    packed = settled(packed)
    alike = rows.groupBy("v", "f", F.pmod("p", F.lit(COPIES)).alias("copy")).agg(F.min("p").alias("p"))
    asked = _settled_cells(alike.select("p", "f", "v"), cells, block)
    asked = settled(asked.repartition("c", F.pmod("p", F.lit(8))).sortWithinPartitions("c").select("p", "f", "v", F.lit(float("inf")).alias("d")))
    spans = np.array(barred, dtype=np.int64)
    early = settled(_routed(asked, cells, open_, k, block, True))
    found = settled(_met(early, packed, spans, k).drop("i"))
    visited = early.select("c", F.explode("asks.p").alias("p")).groupBy("p").agg(F.collect_set("c").alias("seen"))
    bound = found.groupBy("p").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("d"))
    late = asked.drop("d").join(bound, "p").join(visited, "p").select("p", "f", "v", "d", "seen")
    late = late.withColumn("c", F.element_at("seen", 1)).repartition("c", F.pmod("p", F.lit(8))).sortWithinPartitions("c").drop("c")
    more = _met(_routed(late, cells, open_, k, block, False), packed, spans, k).drop("i")
    last = Window.partitionBy("p").orderBy("d", "t")
    best = found.unionByName(more).withColumn("i", F.row_number().over(last)).where(F.col("i") <= k)
    answers = best.groupBy(F.col("p").alias("asker")).agg(F.collect_list(F.struct("t", "y", "d")).alias("best"))
    who = rows.select("p", "v", "f", F.pmod("p", F.lit(COPIES)).alias("copy")).join(alike.withColumnRenamed("p", "asker"), ["v", "f", "copy"]).select("p", "asker")
    return who.join(answers, "asker").select("p", F.inline("best"))
