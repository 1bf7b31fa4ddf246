"""Sweeps of decoders: targets x components x folds x embargoes x null draws, all from one pass of second moments.

What a ridge model of any leading components needs are blocks of one moment matrix, and so does its error on a fold that
it was not fitted on. So rows are read once, with all targets, detrended ones and null draws side by side, and every cell
of a sweep is a small solve. Logistic models of all folds take their Newton steps together, a pass for each step.

Positions are dense from 0. Folds are contiguous; rows within an embargo of a test fold don't train its model. Rows whose
vector or any target is NULL don't count. A fold without spread in its target, or without training rows, has no score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators import decoding
from tracegrid.operators.decoding import fold_edges, near_folds, ridge_weights
from tracegrid.operators.linalg import Moments, mapped, matrix, moments, partial_least_squares
from tracegrid.operators.ordered import joined
from tracegrid.operators.series import detrended_all
from tracegrid.operators.settle import settled
from tracegrid.operators.stats import auc

RESULT = "target string, k int, embargo int, fold int, r2 double"


def fold_moments(df: DataFrame, vector: str, pos: str, edges: list[int], embargoes: list[int]) -> tuple[dict[int, Moments], dict[tuple[int, int], Moments]]:
    """(fold -> moments of its test rows, (embargo, fold) -> moments of its training rows), in one pass."""
    folds = len(edges) - 1
    own = near_folds(pos, edges, 0)
    mark = lambda i, e: F.transform(near_folds(pos, edges, e), lambda k: k + (i + 1) * folds)
    marks = [own, *[mark(i, e) for i, e in enumerate(embargoes) if e]]
    found = moments(df.withColumn("__near", F.explode(F.concat(*marks))), vector, "__near")
    tested = {k: m for k, m in found.items() if k < folds}
    if not tested:
        return {}, {}
    whole = None
    for m in tested.values():
        whole = m if whole is None else whole + m
    train = {(e, k): whole - (found[k + (i + 1) * folds] if e else tested[k]) for i, e in enumerate(embargoes) for k in tested}
    return tested, train


def fold_r2(train: Moments, test: Moments, x: list[int], y: int, alpha: float) -> float | None:
    """R2 on the test rows of the ridge model of place y on places x, from moments alone."""
    if train.n < 2 or test.n < 1:
        return None
    w, b = ridge_weights(train.part([*x, y]), len(x), alpha)
    own = test.part([*x, y])
    total = own.scatter[-1, -1]
    if total <= 1e-12 * max(1.0, abs(own.sums[-2, -2])):
        return None
    c = np.concatenate([-w[:, 0], [1.0], [own.shift[-1] - own.shift[:-1] @ w[:, 0] - b[0]]])  # of rows less their shift
    return float(1 - c @ own.sums @ c / total)


def ridge_sweep(df: DataFrame, vector: str, targets: list[str], pos: str, n: int, ks: list[int], folds: int = 5, embargoes: list[int] = (0,), alpha: float = 1.0, kind: str = "floor") -> DataFrame:
    """(target, k, embargo, fold, r2) for ridge models on the first k places of the vector, for each k, target, embargo and fold."""
    rows = df.where(F.col(vector).isNotNull()).na.drop(subset=targets)
    both = rows.select(pos, F.concat(F.col(vector).cast("array<double>"), F.array(*[F.col(t).cast("double") for t in targets])).alias("__v"))
    edges = fold_edges(n, folds, kind)
    tested, trained = fold_moments(both, "__v", pos, edges, list(embargoes))
    out = []
    for (e, f), train in sorted(trained.items()):
        d = len(train.shift) - len(targets)
        for i, t in enumerate(targets):
            for k in ks:
                if 1 <= k <= d:
                    out.append((t, int(k), int(e), int(f), fold_r2(train, tested[f], list(range(k)), d + i, alpha)))
    return df.sparkSession.createDataFrame(out, RESULT)


def summary(sweep: DataFrame, by: list[str], value: str = "r2") -> DataFrame:
    """(by, mean, std, n): over what is left, folds without a score left out."""
    return sweep.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def decoding_table(df: DataFrame, embeddings: dict[str, str], targets: list[str], pos: str, n: int, folds: int = 5, embargo: int = 0, alpha: float = 1.0) -> DataFrame:
    """(embedding, target, mean, std, n) of R2 over folds, for each vector column and target."""
    out = None
    for name, vector in embeddings.items():
        row = df.select(F.size(vector)).first()
        one = summary(ridge_sweep(df, vector, targets, pos, n, [row[0] if row else 1], folds, [embargo], alpha), ["target"]).select(F.lit(name).alias("embedding"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def moved_round(df: DataFrame, pos: str, n: int, targets: list[str], draws: int, least: int = 0, seed: int = 0) -> DataFrame:
    """df with columns {target}__{draw}: targets moved round by a shift of their own for each draw, from ``least`` to n - least - 1.

    All draws travel in one shuffle: each row is sent to its place in every draw, where a row of values is put together.
    """
    room = max(1, n - 2 * least)
    shift = lambda t, d: F.pmod(F.xxhash64(F.lit(seed), F.lit(t), F.lit(d)), F.lit(room)) + least
    sent = df.select(F.explode(F.array(*[F.struct(F.pmod(F.col(pos) + shift(t, d), F.lit(n)).alias(pos), F.lit(f"{t}__{d}").alias("name"), F.col(t).cast("double").alias("x")) for t in targets for d in range(draws)])).alias("s")).select("s.*")
    wide = sent.groupBy(pos).agg(*[F.max(F.when(F.col("name") == f"{t}__{d}", F.col("x"))).alias(f"{t}__{d}") for t in targets for d in range(draws)])
    return joined(df, wide, [pos])


def named(sweep: DataFrame) -> DataFrame:
    """A sweep's targets of the form name__draw as target and draw; draw is -1 for the real one."""
    parts = F.split("target", "__")
    return sweep.withColumns({"draw": F.when(F.size(parts) > 1, F.element_at(parts, -1).cast("int")).otherwise(-1), "target": F.get(parts, 0)})


def null_sweep(df: DataFrame, vector: str, targets: list[str], pos: str, n: int, ks: list[int], draws: int = 2, folds: int = 5, embargo: int = 0, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(target, k, embargo, fold, r2, draw): the sweep of real targets and of those moved round, from one pass."""
    rows = moved_round(df, pos, n, targets, draws, 0, seed)
    names = [*targets, *[f"{t}__{d}" for t in targets for d in range(draws)]]
    return named(ridge_sweep(rows, vector, names, pos, n, ks, folds, [embargo], alpha))


def detrend_grid(df: DataFrame, vector: str, targets: list[str], pos: str, n: int, k: int, sigmas: list[float], embargoes: list[int], draws: int = 10, folds: int = 5, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(target, sigma, embargo, r2, null, delta, p): the mean R2 of each detrended target, that of its null draws, their difference, and the share of draws as good, itself counted in.

    sigma 0 leaves a target as it is. Every target at every sigma with all its draws is a column of one moment matrix.
    """
    cells = {f"{t}~{s:g}": (t, float(s)) for s in sigmas for t in targets}
    names = list(cells)
    rows = detrended_all(df.select(pos, *targets), [], pos, {c: ts for c, ts in cells.items() if ts[1]}).withColumns({c: F.col(t).cast("double") for c, (t, s) in cells.items() if not s})
    rows = joined(df.select(pos, vector), moved_round(settled(rows.select(pos, *names)), pos, n, names, draws, 0, seed), [pos])
    wide = [*names, *[f"{t}__{d}" for t in names for d in range(draws)]]
    found = named(ridge_sweep(rows, vector, wide, pos, n, [k], folds, embargoes, alpha))
    mean = found.groupBy("target", "embargo", "draw").agg(F.avg("r2").alias("r2"))
    real = mean.where("draw < 0").select("target", "embargo", "r2")
    null = joined(mean.where("draw >= 0").withColumnRenamed("r2", "__n"), real, ["target", "embargo"]).groupBy("target", "embargo").agg(F.avg("__n").alias("null"), F.count_if(F.col("__n") >= F.col("r2")).alias("__as"), F.count("__n").alias("__c"))
    out = joined(real, null, ["target", "embargo"])
    cut = F.split("target", "~")
    return out.select(F.get(cut, 0).alias("target"), F.get(cut, 1).cast("double").alias("sigma"), "embargo", "r2", "null", (F.col("r2") - F.col("null")).alias("delta"), ((F.coalesce("__as", F.lit(0)) + 1) / (F.coalesce("__c", F.lit(0)) + 1)).alias("p"))


def logistic_folds(df: DataFrame, vector: str, y: str, pos: str, n: int, folds: int = 5, embargo: int = 0, c: float = 1.0, steps: int = 15, kind: str = "floor") -> dict[int, np.ndarray]:
    """fold -> weights and, last, the intercept of its L2-penalised logistic model (penalty 1 / (2 C), intercept free).

    Each Newton step is one pass: a row adds its weighted products to every fold that it trains.
    """
    rows = settled(df.where(F.col(vector).isNotNull() & F.col(y).isNotNull()).select(F.col(pos).cast("bigint").alias("p"), F.concat(F.col(vector).cast("array<double>"), F.array((F.col(y) > 0).cast("double"))).alias("v")))
    edges = fold_edges(n, folds, kind)
    row = rows.select(F.size("v")).first()
    if row is None:
        return {}
    d = row[0]
    beta = {f: np.zeros(d) for f in range(folds) if edges[f + 1] > edges[f]}
    open_ = set(beta)
    for _ in range(steps):
        now = {f: beta[f] for f in sorted(open_)}

        def part(batches, now=now):
            sums = {f: np.zeros((d, d + 1)) for f in now}
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    some = batch.slice(at, 4096)
                    p, v = some.column(0).to_numpy(), matrix(some.column(1))
                    target, v = v[:, -1].copy(), np.hstack([v[:, :-1], np.ones((len(v), 1))])
                    for f, b in now.items():
                        mine = (p < edges[f] - embargo) | (p > edges[f + 1] - 1 + embargo)
                        x = v[mine]
                        z = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
                        weight = np.maximum(z * (1 - z), 1e-9)
                        sums[f][:, :-1] += (x * weight[:, None]).T @ x
                        sums[f][:, -1] += x.T @ (target[mine] - z)
            for f, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([f] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array(s.tolist(), pa.list_(pa.float64()))], ["f", "i", "row"])

        cells = rows.mapInArrow(part, "f bigint, i bigint, row array<double>").select("f", "i", F.posexplode("row").alias("j", "x")).groupBy("f", "i", "j").agg(F.sum("x").alias("x")).collect()  # d squared numbers a fold
        full = {f: np.zeros((d, d + 1)) for f in now}
        for r in cells:
            full[r["f"]][r["i"], r["j"]] = r["x"]
        penalty = np.append(np.full(d - 1, 1 / c), 0.0)
        for f, b in now.items():
            step = np.linalg.solve(full[f][:, :-1] + np.diag(penalty + 1e-12), full[f][:, -1] - penalty * b)
            beta[f] = b + step
            if np.abs(step).max() < 1e-10:
                open_.discard(f)
        if not open_:
            break
    return beta


def logistic_oof(df: DataFrame, vector: str, y: str, pos: str, n: int, folds: int = 5, embargo: int = 0, c: float = 1.0, kind: str = "floor") -> DataFrame:
    """(pos, fold, y, pred_y): the probability of the larger label by the model of each row's fold."""
    beta = logistic_folds(df, vector, y, pos, n, folds, embargo, c, kind=kind)
    rows = df.where(F.col(y).isNotNull()).withColumn("fold", F.element_at(near_folds(pos, fold_edges(n, folds, kind), 0), 1).cast("bigint"))

    def predict(v, keys):
        out = np.full(len(v), np.nan)
        for f in np.unique(keys["fold"]):
            mine = keys["fold"] == f
            out[mine] = 1 / (1 + np.exp(-np.clip(v[mine] @ beta[f][:-1] + beta[f][-1], -500, 500)))
        return {f"pred_{y}": out}

    return mapped(rows, vector, {f"pred_{y}": "double"}, predict, [pos, "fold", y])


def logistic_auc(df: DataFrame, vector: str, targets: list[str], pos: str, n: int, folds: int = 5, embargo: int = 0, c: float = 1.0) -> DataFrame:
    """(target, fold, auc) of models in blocked folds; a fold with one label alone has none."""
    out = None
    for t in targets:
        scored = settled(logistic_oof(df, vector, t, pos, n, folds, embargo, c))
        one = auc(scored, ["fold"], F.col(t) > 0, f"pred_{t}").select(F.lit(t).alias("target"), "*")
        out = one if out is None else out.unionByName(one)
    return out


#: Decoders by name; classification takes C = 1 / alpha.
DECODERS = ("ridge", "ridgecv", "knn", "logistic", "pls", "cca")
ALPHAS = tuple(10.0 ** (-2 + 0.5 * k) for k in range(13))


def decoder(name: str, task: str = "regression", alpha: float = 1.0, k_nn: int = 15, alphas: tuple[float, ...] = ALPHAS, components: int = 2) -> Callable[..., DataFrame]:
    """A function (df, vector, targets, pos, n, folds, embargo) -> (pos, fold, targets, pred_ columns) of predictions by models that did not see the row."""
    if name not in DECODERS:
        raise ValueError(f"unknown decoder {name!r}; there are {DECODERS}")
    if task not in ("regression", "classification"):
        raise ValueError(f"unknown task {task!r}")
    if task == "classification" and name in ("ridge", "ridgecv"):
        name = "logistic"

    def run(df: DataFrame, vector: str, targets: list[str], pos: str, n: int, folds: int = 5, embargo: int = 0) -> DataFrame:
        if name == "ridge":
            return decoding.ridge_oof(df, vector, targets, pos, n, folds, embargo, alpha)
        if name in ("knn", "logistic"):
            out = None
            for t in targets:
                one = logistic_oof(df, vector, t, pos, n, folds, embargo, 1 / alpha) if name == "logistic" else joined(df.where(F.col(t).isNotNull()).select(pos, F.element_at(near_folds(pos, fold_edges(n, folds), 0), 1).cast("bigint").alias("fold"), t), decoding.knn_oof(df, vector, t, pos, n, folds, embargo, k_nn).withColumnRenamed("pred", f"pred_{t}"), [pos])
                out = one if out is None else joined(out, one.drop("fold"), [pos], "inner")
            return out
        rows = df.where(F.col(vector).isNotNull()).na.drop(subset=targets)
        both = rows.select(pos, *targets, F.concat(F.col(vector).cast("array<double>"), F.array(*[F.col(t).cast("double") for t in targets])).alias("__v"))
        edges = fold_edges(n, folds)
        tested, trained = fold_moments(both, "__v", pos, edges, [embargo])
        models = {}
        for (_, f), m in trained.items():
            nx = len(m.shift) - len(targets)
            if name == "ridgecv":
                # The weight is chosen by leaving out one of the other folds at a time.
                inner = {g: m - tested[g] for g in tested if g != f} if len(tested) > 2 else {f: m}
                best = decoding.best_alpha(inner, {g: tested[g] if g != f else m for g in inner}, nx, list(alphas))
                models[f] = ridge_weights(m, nx, best)
            else:
                k = min(components, nx, len(targets)) if name == "cca" else min(components, nx)
                models[f] = blocks_model(m, nx, k, name)
        rows = both.withColumn("fold", F.element_at(near_folds(pos, edges, 0), 1).cast("bigint"))

        def predict(v, keys):
            out = np.full((len(v), len(targets)), np.nan)
            for f in np.unique(keys["fold"]):
                if f in models:
                    mine = keys["fold"] == f
                    out[mine] = v[mine, : -len(targets)] @ models[f][0] + models[f][1]
            return {f"pred_{t}": out[:, i] for i, t in enumerate(targets)}

        return mapped(rows, "__v", {f"pred_{t}": "double" for t in targets}, predict, [pos, "fold", *targets])

    return run


def blocks_model(m: Moments, nx: int, k: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(weights, intercepts) of y on x by k latent pairs: pls on scaled places, or the regression on the first k canonical pairs."""
    s = m.scatter / max(m.n, 1.0)
    if name == "pls":
        d = np.sqrt(np.where(np.diag(s) > 0, np.diag(s), 1.0))
        w = partial_least_squares(m, nx, k) / d[:nx, None] * d[None, nx:]
    else:
        _, a, _ = pairs_of(s, nx, k)
        w = a @ np.linalg.solve(a.T @ s[:nx, :nx] @ a + 1e-12 * np.eye(a.shape[1]), a.T @ s[:nx, nx:])
    return w, m.mean[nx:] - m.mean[:nx] @ w


def pairs_of(s: np.ndarray, nx: int, k: int, ridge: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical correlations and weights from covariance blocks, as linalg.canonical finds them from rows."""
    root = lambda c: np.linalg.inv(np.linalg.cholesky(c + ridge * max(1.0, np.trace(c)) * np.eye(len(c))))
    rx, ry = root(s[:nx, :nx]), root(s[nx:, nx:])
    u, r, v = np.linalg.svd(rx @ s[:nx, nx:] @ ry.T)
    return r[:k], rx.T @ u[:, :k], ry.T @ v[:k].T


def in_sample(df: DataFrame, vector: str, targets: list[str], pos: str, alpha: float = 1.0, task: str = "regression") -> DataFrame:
    """(pos, targets, pred_ columns) by the model of all rows, which are the rows it predicts."""
    rows = df.where(F.col(vector).isNotNull()).na.drop(subset=targets)
    if task == "classification":
        out = None
        for t in targets:
            beta = logistic_folds(rows.withColumn(pos, F.col(pos) + 1), vector, t, pos, 1, 1, 0, 1 / alpha)  # a fold that none of the rows lies in
            one = mapped(rows, vector, {f"pred_{t}": "double"}, lambda v, _, b=beta.get(0), t=t: {f"pred_{t}": 1 / (1 + np.exp(-np.clip(v @ b[:-1] + b[-1], -500, 500)))}, [pos, t])
            out = one if out is None else joined(out, one, [pos], "inner")
        return out
    both = rows.select(pos, *targets, F.concat(F.col(vector).cast("array<double>"), F.array(*[F.col(t).cast("double") for t in targets])).alias("__v"))
    m = moments(both, "__v")[None]
    if not m.n:
        return both.select(pos, *targets, *[F.lit(None).cast("double").alias(f"pred_{t}") for t in targets])
    w, b = ridge_weights(m, len(m.shift) - len(targets), alpha)
    return mapped(both, "__v", {f"pred_{t}": "double" for t in targets}, lambda v, _: {f"pred_{t}": v[:, : -len(targets)] @ w[:, i] + b[i] for i, t in enumerate(targets)}, [pos, *targets])


def loadings(df: DataFrame, embedding: str, vector: str, alpha: float = 1.0) -> np.ndarray:
    """Ridge coefficients (places of the vector x latents) that make a vector from an embedding: what each latent adds to each place."""
    row = df.select(F.size(embedding)).first()
    if row is None:
        return np.empty((0, 0))
    both = df.where(F.col(embedding).isNotNull() & F.col(vector).isNotNull()).select(F.concat(F.col(embedding).cast("array<double>"), F.col(vector).cast("array<double>")).alias("__v"))
    return ridge_weights(moments(both, "__v")[None], row[0], alpha, standardise=False)[0].T


def variance_curve(df: DataFrame, vector: str, pos: str, n: int, draws: int = 5, seed: int = 0) -> DataFrame:
    """(comp, ratio, cumulative, null_low, null_high): shares of variance, and the band of cumulative ones over draws in which every place is moved round by a shift of its own.

    All draws are put together in one shuffle and measured in one pass.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(pos).alias("p"), F.col(vector).cast("array<double>").alias("v"))
    real = moments(rows, "v")[None]
    d = len(real.shift)
    if not d:
        return df.sparkSession.createDataFrame([], "comp bigint, ratio double, cumulative double, null_low double, null_high double")
    long = rows.select("p", F.posexplode("v").alias("j", "x")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    long = long.withColumn("p", F.pmod(F.col("p") + F.pmod(F.xxhash64(F.lit(seed), "draw", "j"), F.lit(n)), F.lit(n)))
    wide = long.groupBy("draw", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("v"))  # d values a row
    null = moments(wide, "v", "draw", shift=real.shift)
    share = lambda m: (e := np.maximum(np.linalg.eigvalsh(m.scatter)[::-1], 0.0)) / max(e.sum(), 1e-300)
    ratio, nulls = share(real), np.array([np.cumsum(share(m)) for m in null.values()])
    rows = [(k, float(ratio[k]), float(ratio[: k + 1].sum()), float(nulls[:, k].min()), float(nulls[:, k].max())) for k in range(d)]
    return df.sparkSession.createDataFrame(rows, "comp bigint, ratio double, cumulative double, null_low double, null_high double")
