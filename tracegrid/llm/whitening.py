"""Embedding whitening by cyclic Jacobi rotations of a distributed, centred scatter matrix.

Entries c become whole numbers x = floor(SCALE * c) + SHIFT, and the model is fitted on each distinct x-vector once.
Sums per dimension are exact decimals. A second pass adds up outer products of rows that are centred before they are
multiplied: by the nearest whole number to the mean, exactly, and then by what is left of it. Only a d x d matrix
reaches the driver, where symmetric Jacobi rotations go round all pairs of dimensions until no off-diagonal entry
matters beside its own two diagonal ones, which gives small eigenvalues as accurately as large ones. The sorted
whitening matrix goes to every task, and a third pass measures the covariance of what it makes.

Edge cases: rows whose vector is null or holds null or non-finite entries go; an empty vector gives no components;
vectors of different lengths are fitted apart; entries beyond +-2**40 / SCALE count as that; ids may be null or repeat,
and every row is whitened; a direction without variance (ROUNDING of the greatest eigenvalue or less, where there is
only rounding) has whitened null and does not count in identity_error; a deviation that no bigint holds is null; a
single distinct vector has no variance at all, so explained is null as well; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.shared import finite, settled

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: The greatest size of floor(SCALE * c); share of the greatest eigenvalue under which one is rounding only.
LARGEST, ROUNDING = 1 << 40, 1e-14
SWEEPS = 60


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, in no order.

    A sweep visits every pair of dimensions once, d / 2 disjoint pairs at a time, as in a round of a tournament.
    """
    a, d = np.array(a, dtype=np.float64), len(a)
    v = np.eye(d)
    seats = np.arange(d + d % 2)  # an odd player sits out against the seat d
    tiny = np.finfo(float).tiny
    for _ in range(SWEEPS):
        still = True
        for _ in range(max(0, len(seats) - 1)):
            p, q = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < d], q[q < d]
            off, x, y = a[p, q], a[p, p], a[q, q]
            turn = np.abs(off) > np.maximum(np.finfo(float).eps / 4 * np.sqrt(np.abs(x)) * np.sqrt(np.abs(y)), tiny)
            p, q, off, x, y = (z[turn] for z in (p, q, off, x, y))
            if len(p):
                still = False
                # tan of the smaller of the two angles that make the entry vanish
                with np.errstate(over="ignore"):
                    half = (y - x) / (2 * off)
                    t = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(half, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                for m in (a, v):
                    left, right = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = left * c - right * s, left * s + right * c
                up, low = a[p].copy(), a[q].copy()
                a[p], a[q] = up * c[:, None] - low * s[:, None], up * s[:, None] + low * c[:, None]
                a[p, q] = a[q, p] = 0.0
                a[p, p], a[q, q] = x - t * off, y + t * off
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if still:
            break
    return np.diag(a).copy(), v


def whole_numbers(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x array<bigint>) of the rows that remain."""
    c = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * SCALE, F.lit(-2.0 * LARGEST)), F.lit(2.0 * LARGEST))), F.lit(-LARGEST)), F.lit(LARGEST)) + SHIFT
    rows = df.where(finite(vector)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.select("key", F.transform("v", c).alias("x"))


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def added(rows: DataFrame, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows (x) of what ``made`` gives for a matrix of them: a matrix of doubles, a row of it to a group."""

    def part(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                one = made(matrix(batch.column(0).slice(at, 4096)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def total(batches):  # as many rows of each i as the pass has tasks, added up as they come
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[i] = held.get(i, 0.0) + np.frombuffer(row)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([r.tobytes() for r in held.values()], pa.binary())], ["i", "row"])

    found = rows.select("x").mapInArrow(part, "i int, row binary").repartition("i").mapInArrow(total, "i int, row binary").collect()  # d rows of d numbers
    return np.array([np.frombuffer(r["row"]) for r in sorted(found, key=lambda r: r["i"])])


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def part(batches):
        count, total = 0, [0] * dim
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):  # 4096 * 2**41 is far from the end of 64 bits
                x = matrix(batch.column(0).slice(at, 4096))
                count, total = count + len(x), [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([count] * dim, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "n", "s"])

    rows = fit.select("x").mapInArrow(part, "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()  # a row for each dimension
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


@dataclass(frozen=True)
class Whitening:
    """n rows of sums S, with S / n = base + rest; directions (d x k), eigenvalues and shares of the trace, greatest first."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    short: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN along directions without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centred(x) @ self.directions / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)**2."""
        y = x - self.base
        if (self.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * max(1, y.shape[1]) < 1 << 63:
            return ((self.n * y - np.array(self.short, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        found = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.short, strict=True)) for row in y.tolist()]
        return [f if f < 1 << 63 else None for f in found]


def fitted(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of distinct rows x of length dim."""
    n, s = sums(fit, dim)
    base = [round(Fraction(t, n)) for t in s]
    short = [t - n * b for t, b in zip(s, base, strict=True)]
    start = Whitening(n, np.array(base, dtype=np.int64), np.array([t / n for t in short]), short, np.empty((dim, 0)), np.empty(0), np.empty(0))

    def outer(x: np.ndarray) -> np.ndarray:
        y = start.centred(x)
        return y.T @ y

    scatter = added(fit, outer) / n
    trace = float(np.trace(scatter))
    values, directions = jacobi(scatter)
    order = np.argsort(-values, kind="stable")[:components]
    values, directions = values[order], directions[:, order]
    values = np.where(values > ROUNDING * max(values.max(initial=0.0), 0.0), values, 0.0)
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, start.base, start.rest, short, directions, values, values / trace if trace > 0 else np.full(len(order), np.nan))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity; 0 without a direction."""
    some = model.values > 0

    def moments(x: np.ndarray) -> np.ndarray:
        z = np.hstack([model.whitened(x)[:, some], np.ones((len(x), 1))])
        return z.T @ z

    m = added(fit, moments) / model.n
    return float(np.abs(m[:-1, :-1] - np.outer(m[:-1, -1], m[:-1, -1]) - np.eye(int(some.sum()))).max(initial=0.0))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): ``components`` rows, or as many as there are dimensions, for each that remains."""
    rows = whole_numbers(df, key, vector).where(F.size("x") > 0)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    distinct = settled(rows.select("x").distinct())
    out = None
    for dim in sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect()):
        fit = distinct.where(F.size("x") == dim)
        model = fitted(fit, dim, components)
        error = identity_error(fit, model)

        def run(batches, model=model, error=error):
            k = len(model.values)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = matrix(part.column(1))
                    n = len(x)
                    columns = [
                        part.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, model.n)),
                        pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(model.whitened(x).reshape(-1), from_pandas=True),
                        pa.array(np.tile(model.explained, n), from_pandas=True),
                        pa.array(np.full(n * k, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        one = rows.where(F.size("x") == dim).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
