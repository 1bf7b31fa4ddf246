"""Blocked cross-validation, decoders and null models, all from moments of folds.

Rows have a dense position ``pos`` and belong to contiguous folds; an embargo takes rows on both sides of a test fold out
of its training. The training moments of a fold are all rows' minus those of the fold with its embargo, so the rows are
read once for all folds, and once more to predict.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tracegrid.operators.linalg import Moments, mapped, moments
from tracegrid.operators.neighbours import BLOCK, nearest_allowed
from tracegrid.operators.ordered import joined
from tracegrid.operators.settle import settled
from tracegrid.operators.stats import auc


def fold_edges(n: int, folds: int = 5, kind: str = "floor") -> list[int]:
    """Edges of contiguous folds. floor: the last takes the remainder; ceil: all as long as the first, the last ones shorter or empty."""
    if kind == "floor":
        return [k * (n // folds) for k in range(folds)] + [n]
    if kind == "ceil":
        return [min(n, k * math.ceil(n / folds)) for k in range(folds + 1)]
    raise ValueError("kind is 'floor' or 'ceil'")


def fold_of(pos: str, n, folds: int = 5, kind: str = "floor") -> Column:
    """The same as an expression; n may be a column."""
    n = F.col(n) if isinstance(n, str) else F.lit(n)
    size = F.greatest(F.floor(n / folds) if kind == "floor" else F.ceil(n / folds), F.lit(1))
    return F.least(F.floor(F.col(pos) / size), F.lit(folds - 1)).cast("int")


def near_folds(pos: str, edges: list[int], embargo: int) -> Column:
    """Array of the folds whose test rows, or their embargo, a row lies in."""
    return F.filter(F.array(*[F.when(F.col(pos).between(a - embargo, b - 1 + embargo), F.lit(k)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]), lambda k: k.isNotNull())


def training(df: DataFrame, vector: str, pos: str, edges: list[int], embargo: int) -> dict[int, Moments]:
    """fold -> moments of its training rows."""
    whole = moments(df, vector)[None]  # zeros if there are no rows, and then no fold has any
    out = moments(df.withColumn("__near", F.explode(near_folds(pos, edges, embargo))), vector, "__near", shift=whole.shift)
    return {k: whole - s for k, s in out.items()}


def ridge_weights(m: Moments, nx: int, alpha: float, standardise: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(weights, intercepts) of y on x from the moments of (x, y); x is scaled by its population deviation first."""
    s, n = m.scatter, max(m.n, 1.0)
    d = np.sqrt(np.maximum(np.diag(s)[:nx] / n, 0.0)) if standardise else np.ones(nx)
    d = np.where(d > 0, d, 1.0)
    w = np.linalg.solve(s[:nx, :nx] / np.outer(d, d) + alpha * np.eye(nx), s[:nx, nx:] / d[:, None]) / d[:, None]
    return w, m.mean[nx:] - m.mean[:nx] @ w


def ridge_oof(df: DataFrame, x: str, y: list[str], pos: str, n: int, folds: int = 5, embargo: int = 0, alpha: float = 1.0, kind: str = "floor") -> DataFrame:
    """(pos, fold, y columns, pred_ columns): predictions for each row by the model of its fold. Rows with a NULL target don't count."""
    edges = fold_edges(n, folds, kind)
    rows = df.na.drop(subset=y).withColumn("__xy", F.concat(F.col(x).cast("array<double>"), F.array(*[F.col(c).cast("double") for c in y])))
    trained = training(rows, "__xy", pos, edges, embargo)
    models = {k: ridge_weights(m, len(m.mean) - len(y), alpha) for k, m in trained.items() if m.n >= 2}
    rows = rows.withColumn("fold", F.expr(f"size(filter(array({', '.join(f'{e}L' for e in edges[1:-1])}), e -> e <= `{pos}`))").cast("bigint") if folds > 1 else F.lit(0).cast("bigint"))

    def predict(v, keys):
        out = np.full((len(v), len(y)), np.nan)
        for k in np.unique(keys["fold"]):
            if k in models:
                mine = keys["fold"] == k
                out[mine] = v[mine, : -len(y)] @ models[k][0] + models[k][1]
        return {f"pred_{c}": out[:, i] for i, c in enumerate(y)}

    return mapped(rows, "__xy", {f"pred_{c}": "double" for c in y}, predict, [pos, "fold", *y])


def r2_by_fold(oof: DataFrame, y: str) -> DataFrame:
    """(fold, r2); a fold whose target does not vary has none."""
    stats = oof.groupBy("fold").agg(F.sum(F.pow(F.col(y) - F.col(f"pred_{y}"), 2)).alias("e"), F.count("*").alias("n"), F.var_pop(y).alias("v"))
    return stats.select("fold", (1 - F.try_divide(F.col("e"), F.col("n") * F.col("v"))).alias("r2"))


def auc_by_fold(oof: DataFrame, y: str) -> DataFrame:
    return auc(oof, ["fold"], F.col(y) > 0, f"pred_{y}")


def pooled_fit(oof: DataFrame, y: str) -> DataFrame:
    """One row: slope and intercept of predicted on actual, and R2 over all rows together."""
    p = f"pred_{y}"
    s = oof.agg(F.regr_slope(p, y).alias("slope"), F.regr_intercept(p, y).alias("intercept"), F.sum(F.pow(F.col(y) - F.col(p), 2)).alias("e"), (F.var_pop(y) * F.count(y)).alias("t"))
    return s.select("slope", "intercept", (1 - F.try_divide("e", "t")).alias("r2"))


def best_alpha(trained: dict[int, Moments], tested: dict[int, Moments], nx: int, grid: list[float]) -> float:
    """The ridge weight with the least squared error over all folds, one for all outputs, from moments alone."""

    def error(alpha: float) -> float:
        total = 0.0
        for k, m in trained.items():
            w, b = ridge_weights(m, nx, alpha)
            c = np.vstack([-w, np.eye(w.shape[1]), -b[None, :]])
            total += np.trace(c.T @ tested[k].raw @ c)
        return total

    return min(grid, key=error)


def logistic(df: DataFrame, x: str, y: str, c: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights and, last, the intercept of an L2-penalised logistic model (penalty 1 / (2 C), intercept free), by Newton's steps."""
    row = df.select(F.size(x)).first()
    if row is None:
        return np.empty(0)
    d = row[0]
    beta = np.zeros(d + 1)
    rows = settled(df.na.drop(subset=[y]).select(F.concat(F.col(x).cast("array<double>"), F.array(F.col(y).cast("double"))).alias("__xy"), F.lit(0).cast("bigint").alias("__k")))
    for _ in range(steps):
        now = beta

        def weigh(v, _, now=now):
            z = v[:, :-1] @ now[:-1] + now[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-9)
            return {"w": w, "zv": np.hstack([v[:, :-1], (z + (v[:, -1] - p) / w)[:, None]])}

        s = moments(mapped(rows, "__xy", {"w": "double", "zv": "array<double>"}, weigh, ["__k"]), "zv", weight="w")[None].raw
        keep = [*range(d), d + 1]
        penalty = np.diag([1 / c] * d + [0.0])
        beta = np.linalg.solve(s[np.ix_(keep, keep)] + penalty, s[keep, d])
        if np.abs(beta - now).max() < 1e-10:
            break
    return beta


def knn_oof(df: DataFrame, x: str, y: str, pos: str, n: int, folds: int = 5, embargo: int = 0, k: int = 15, block: int = BLOCK) -> DataFrame:
    """(pos, pred): mean of the k nearest training rows' targets, weighted by one over distance; rows at distance 0 take all.

    Of equal distances the lower position counts. Rows with a NULL target or vector, or a component that is NULL or not
    finite, take no part; a row without any training row has no prediction.
    """
    edges = fold_edges(n, folds)
    inner = F.lit(0)
    for e in edges[1:-1]:
        inner = inner + (F.col("p") >= F.lit(e)).cast("int")
    rows = df.select(F.col(pos).cast("bigint").alias("p"), F.col(x).cast("array<double>").alias("v"), F.col(y).cast("double").alias("y")).withColumn("f", inner)
    best = nearest_allowed(rows, [(a - embargo, b + embargo) for a, b in zip(edges, edges[1:], strict=False)], k, n, block)
    exact = F.max((F.col("d") == 0).cast("int")) == 1
    mean = F.when(exact, F.avg(F.when(F.col("d") == 0, F.col("y")))).otherwise(F.sum(F.try_divide(F.col("y"), F.col("d"))) / F.sum(F.try_divide(F.lit(1.0), F.col("d"))))
    return best.groupBy(F.col("p").alias(pos)).agg(mean.alias("pred"))


def drawn_shifts(keys: DataFrame, key: str, draws: int, n: int | str, least: int = 0, seed: int = 0) -> DataFrame:
    """(draw, key, shift): shifts from ``least`` to n - least - 1, from a hash of seed, draw and key. n may be a column of keys, one value for each key."""
    size = F.col(n) if isinstance(n, str) else F.lit(n)
    rows = keys.select(key, size.alias("__n")).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return rows.select("draw", key, (F.pmod(F.xxhash64(F.lit(seed), "draw", key), F.greatest(F.lit(1), F.col("__n") - 2 * least)) + least).alias("shift"))


def circular(df: DataFrame, shifts: DataFrame, key: str, pos: str, n: int | str) -> DataFrame:
    """Every draw's rows, each key moved round by its shift. n is the length of the series, or the column of df that has it."""
    return df.join(shifts, key).withColumn(pos, F.pmod(F.col(pos) + F.col("shift"), F.col(n) if isinstance(n, str) else F.lit(n))).drop("shift")


def scrambled(df: DataFrame, by: list[str], pos: str, values: list[str], seed: int = 0, parts: int = 256) -> DataFrame:
    """Values of each series in an order drawn by hash; positions, dense from 0, stay.

    The hash's ranges are even by nature, so rows are ordered within each of ``parts`` of them, and only their sizes over a series.
    """
    rows = df.select(*by, *values, F.col(pos).alias("__pos"), F.xxhash64(F.lit(seed), *by, pos).alias("__h")).withColumn("__p", F.shiftright("__h", 56).cast("int") if parts == 256 else F.pmod("__h", F.lit(parts)).cast("int"))
    sizes = rows.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = sizes.select(*by, "__p", (F.sum("__n").over(Window.partitionBy(*by).orderBy("__p")) - F.col("__n")).alias("__before"))  # a row for each range
    row = F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__h", "__pos")) - 1
    moved = joined(rows.withColumn("__row", row), before, [*by, "__p"]).select(*by, *values, (F.col("__row") + F.col("__before")).cast("bigint").alias(pos))
    return joined(df.drop(*values), moved, [*by, pos])


def chunk_order(n: int, size: int, seed: int = 0) -> dict[int, int]:
    """old chunk -> new place, for whole chunks of a series of n."""
    order = np.random.default_rng(seed).permutation(max(1, math.ceil(n / size)))
    return {int(c): k for k, c in enumerate(order)}


def resampled_means(df: DataFrame, by: list[str], trial: str, value: str, draws: int, seed: int = 0, block: int = 1 << 20) -> DataFrame:
    """(by, draw, mean): means of as many trials as there are, drawn with replacement by hash. Trials are dense from 0 within ``by``.

    The k-th trial of a draw is xxhash64(seed, by, draw, k) modulo their number. A group's values stand in arrays of at most
    ``block``; draws are hashed beside them and give up only sums and counts, so that no drawn trial is ever a row.
    """
    import pyarrow as pa

    rows = df.select(*by, F.col(trial).cast("bigint").alias("__t"), F.col(value).cast("double").alias("__v"))
    n = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    packs = rows.where("__t is not null").groupBy(*by, F.floor(F.col("__t") / block).alias("__b")).agg(F.collect_list(F.struct("__t", "__v")).alias("__rows"))
    step = F.greatest(F.lit(1), F.least(F.lit(draws), F.floor(F.lit(1 << 24) / F.col("__n")))).cast("int")
    parts = joined(packs, n, by).withColumn("__lo", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), step)))
    hashes = F.transform(F.sequence("__lo", F.least(F.lit(draws), F.col("__lo") + step) - 1), lambda d: F.xxhash64(F.lit(seed), *by, d))
    parts = parts.select(*by, "__b", "__n", "__lo", hashes.alias("__h"), "__rows").repartition(*by, "__b", "__lo")

    def draw(batches):
        for batch in batches:
            n, b, lo = (batch.column(c).to_numpy() for c in ("__n", "__b", "__lo"))
            found = []
            for i in range(batch.num_rows):
                held, starts = batch.column("__rows")[i].values, batch.column("__h")[i].values.to_numpy()
                t, v = held.field("__t").to_numpy() - b[i] * block, held.field("__v")
                size = int(t.max()) + 1
                known = np.zeros(size + 1)  # the last place is for trials of other blocks
                known[t] = v.is_valid().to_numpy(zero_copy_only=False)
                values = np.zeros(size + 1)
                values[t] = v.fill_null(0.0).to_numpy()
                total, count = np.zeros(len(starts)), np.zeros(len(starts))
                wide = max(1, (1 << 16) // n[i])
                for at in range(0, len(starts), wide):
                    for k in range(0, n[i], 1 << 16):
                        picked = long_hashes(starts[at : at + wide, None], np.arange(k, min(n[i], k + (1 << 16)))[None, :]) % n[i] - b[i] * block
                        picked[(picked < 0) | (picked > size)] = size
                        total[at : at + wide] += values[picked].sum(axis=1)
                        count[at : at + wide] += known[picked].sum(axis=1)
                found.append((lo[i] + np.arange(len(starts)), total, count))
            if found:
                draw_, total, count = (np.concatenate(x) for x in zip(*found, strict=True))
                at = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in by), pa.array(draw_.astype(np.int32)), pa.array(total), pa.array(count.astype(np.int64))], [*by, "draw", "__s", "__c"])

    kinds = StructType([*(parts.schema[c] for c in by), StructField("draw", IntegerType()), StructField("__s", DoubleType()), StructField("__c", LongType())])
    return parts.mapInArrow(draw, kinds).groupBy(*by, "draw").agg(F.try_divide(F.sum("__s"), F.sum("__c")).alias("mean"))


def long_hashes(start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """XXH64 of 8-byte numbers k from given states, as xxhash64 goes on from one column to the next."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, r: x << np.uint64(r) | x >> np.uint64(64 - r)
    h = (start.view(np.uint64) + five + np.uint64(8)) ^ turned(k.astype(np.int64).view(np.uint64) * two, 31) * one
    h = turned(h, 27) * one + four
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return (h ^ h >> np.uint64(32)).view(np.int64)
