"""Factors of row vectors under several losses and penalties, sparse components, and their error on rows left out.

A model of k factors is a k x d matrix H. A row's weights depend on H and the row alone, so they are found where the row
lies, each time from the same start; a pass over the rows adds up what H's next step needs, k x d numbers for each fit.
Many fits, as of a grid of settings and folds, share their passes. Sparse components need second moments only.

Rows with a NULL vector don't count. A NULL or NaN place, and a negative one where factors are non-negative, is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.decoding import fold_edges
from tracegrid.operators.linalg import Moments, mapped, matrix, moments
from tracegrid.operators.ordered import joined
from tracegrid.operators.series import smoothed
from tracegrid.operators.settle import settled

LOSSES = ("frobenius", "kullback-leibler", "itakura-saito")
#: The least value that a division or a logarithm sees.
EPS = 1e-10


@dataclass(frozen=True)
class Fit:
    """Factors (k x d) and the loss after each round."""

    h: np.ndarray
    losses: list[float]


def clean(x: np.ndarray, loss: str) -> np.ndarray:
    x = np.maximum(np.nan_to_num(x, nan=0.0), 0.0)
    return np.maximum(x, EPS) if loss == "itakura-saito" else x


def row_weights(x: np.ndarray, h: np.ndarray, loss: str = "frobenius", inner: int = 50, lasso: float = 0.0, ridge: float = 0.0) -> np.ndarray:
    """Non-negative weights of rows for factors h, by multiplicative steps from an even start."""
    w = np.full((len(x), len(h)), 1.0) * (x.mean(axis=1, keepdims=True) / max(h.mean() * len(h), EPS) + EPS)
    for _ in range(inner):
        up, down = _parts(x, w, h, loss)
        step = (up @ h.T) / np.maximum(down @ h.T + lasso + ridge * w, EPS)
        w = w * (np.sqrt(step) if loss == "itakura-saito" else step)
    return w


def _parts(x: np.ndarray, w: np.ndarray, h: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """What pulls the model up and down at each place."""
    made = w @ h
    if loss == "frobenius":
        return x, made
    made = np.maximum(made, EPS)
    return (x / made, np.ones_like(x)) if loss == "kullback-leibler" else (x / made**2, 1 / made)


def loss_of(x: np.ndarray, made: np.ndarray, loss: str) -> float:
    """Half the squared error, or the generalised divergence."""
    if loss == "frobenius":
        return 0.5 * float(((x - made) ** 2).sum())
    y, made = np.maximum(x, EPS), np.maximum(made, EPS)
    if loss == "kullback-leibler":
        return float((np.where(x > 0, x * np.log(y / made), 0.0) - x + made).sum())
    return float((y / made - np.log(y / made) - 1).sum())


def non_negative(df: DataFrame, vector: str, fits: dict[int, np.ndarray], group: str | None = None, loss: str = "frobenius", rounds: int = 100, inner: int = 50, tol: float = 1e-4, lasso: float = 0.0, ridge: float = 0.0, fixed: int = 0) -> dict[int, Fit]:
    """Fit every start (k x d) of ``fits`` to the rows, or with ``group``, an array<bigint> column of the fits that a row counts for, to its own.

    A round is one pass for all fits. A fit ends when its loss falls by less than ``tol`` of the first. fixed: leading
    factors that stay as they are.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}")
    rows = df.where(F.col(vector).isNotNull()).select((F.col(group) if group else F.array(*[F.lit(g).cast("bigint") for g in fits])).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    rows = settled(rows)
    now, losses = {g: h.copy() for g, h in fits.items()}, {g: [] for g in fits}
    open_ = set(fits)
    for _ in range(rounds):
        if not open_:
            break
        hs = {g: now[g] for g in sorted(open_)}

        def part(batches, hs=hs):
            sums: dict = {}
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    some = batch.slice(at, 1024)
                    x = clean(matrix(some.column(1)), loss)
                    of, values = some.column(0).value_lengths().to_numpy(zero_copy_only=False), some.column(0).flatten().to_numpy()
                    row = np.repeat(np.arange(len(x)), of)
                    for g, h in hs.items():
                        mine = x[row[values == g]]
                        if len(mine):
                            w = row_weights(mine, h, loss, inner, lasso, ridge)
                            up, down = _parts(mine, w, h, loss)
                            made = [w.T @ up, w.T @ down, loss_of(mine, w @ h, loss) + lasso * float(w.sum()) + 0.5 * ridge * float((w * w).sum())]
                            sums[g] = [a + b for a, b in zip(sums[g], made, strict=True)] if g in sums else made
            for g, (up, down, err) in sums.items():
                k = len(up)
                yield pa.RecordBatch.from_arrays([pa.array([g] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array(np.hstack([up, down]).tolist(), pa.list_(pa.float64())), pa.array([err] + [0.0] * (k - 1))], ["g", "i", "row", "err"])

        parts = rows.mapInArrow(part, "g bigint, i bigint, row array<double>, err double")
        cells = parts.select("g", "i", "err", F.posexplode("row").alias("j", "x")).groupBy("g", "i", "j").agg(F.sum("x").alias("x"), F.sum("err").alias("err")).collect()  # 2 k d numbers a fit
        full = {g: np.zeros((len(h), 2 * h.shape[1])) for g, h in hs.items()}
        errors = dict.fromkeys(hs, 0.0)
        for r in cells:
            full[r["g"]][r["i"], r["j"]] = r["x"]
            errors[r["g"]] = max(errors[r["g"]], r["err"])
        for g, h in hs.items():
            losses[g].append(errors[g] + lasso * float(h.sum()) + 0.5 * ridge * float((h * h).sum()))
            up, down = np.hsplit(full[g], 2)
            step = up / np.maximum(down + lasso + ridge * h, EPS)
            step = np.sqrt(step) if loss == "itakura-saito" else step
            now[g] = np.where(np.arange(len(h))[:, None] < fixed, h, h * step)
            if len(losses[g]) > 1 and losses[g][-2] - losses[g][-1] < tol * losses[g][0]:
                open_.discard(g)
    return {g: Fit(now[g], losses[g]) for g in fits}


def start(mean: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A positive start about the places' means."""
    return np.abs(np.random.default_rng(seed).normal(1.0, 0.5, size=(k, len(mean)))) * (np.maximum(mean, 0.0) + 1e-9)


def nmf(df: DataFrame, vector: str, k: int, loss: str = "frobenius", seed: int = 0, **how) -> Fit:
    """Non-negative factors of one setting."""
    m = moments(df.withColumn("__p", F.transform(vector, lambda x: F.greatest(F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))), "__p")[None]
    return non_negative(df, vector, {0: start(m.mean, k, seed)}, loss=loss, **how)[0]


def shrunk(x: np.ndarray, by: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0.0)


def penalised(gram: np.ndarray, cross: np.ndarray, lasso: float, ridge: float, sweeps: int = 2000, tol: float = 1e-10, positive: bool = False, begin: np.ndarray | None = None) -> np.ndarray:
    """Columns b that minimise b'(gram)b / 2 - b'cross + lasso |b| + ridge |b|^2 / 2, by coordinate descent, all columns at once."""
    b = np.zeros_like(cross) if begin is None else begin.copy()
    size = np.diag(gram) + ridge
    for _ in range(sweeps):
        far = 0.0
        for j in range(len(gram)):
            if size[j] <= 0:
                continue
            new = shrunk(cross[j] - gram[j] @ b + gram[j, j] * b[j], lasso) / size[j]
            new = np.maximum(new, 0.0) if positive else new
            far = max(far, float(np.abs(new - b[j]).max(initial=0.0)))
            b[j] = new
        if far < tol:
            break
    return b


def elastic_net(df: DataFrame, vector: str, k: int, alpha: float = 0.1, l1_ratio: float = 0.5, rounds: int = 30, tol: float = 1e-6, positive: bool = False, seed: int = 0) -> Fit:
    """Factors under an elastic net on weights and factors: row by row where rows lie, then place by place from the sums.

    The loss is |X - WH|^2 / 2 + alpha l1_ratio (|W| + |H|) + alpha (1 - l1_ratio) (|W|^2 + |H|^2) / 2, and falls in every round.
    """
    rows = settled(df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")))
    m = moments(rows, "v")[None]
    if not len(m.mean):
        return Fit(np.empty((k, 0)), [])
    lasso, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio)
    h = np.random.default_rng(seed).normal(size=(k, len(m.mean))) * np.sqrt(np.maximum(np.diag(m.raw)[:-1] / max(m.n, 1.0), 1e-12))
    h = np.abs(h) if positive else h
    losses: list[float] = []
    for _ in range(rounds):
        now = h

        def part(batches, now=now):
            ww, wx, err = 0.0, 0.0, 0.0
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    x = np.nan_to_num(matrix(batch.column(0).slice(at, 4096)), nan=0.0)
                    w = penalised(now @ now.T, now @ x.T, lasso, ridge, positive=positive).T
                    ww, wx = ww + w.T @ w, wx + w.T @ x
                    err += 0.5 * float(((x - w @ now) ** 2).sum()) + lasso * float(np.abs(w).sum()) + 0.5 * ridge * float((w * w).sum())
            if not np.isscalar(ww):
                yield pa.RecordBatch.from_arrays([pa.array(range(len(now)), pa.int64()), pa.array(np.hstack([ww, wx]).tolist(), pa.list_(pa.float64())), pa.array([err] + [0.0] * (len(now) - 1))], ["i", "row", "err"])

        parts = rows.mapInArrow(part, "i bigint, row array<double>, err double").select("i", "err", F.posexplode("row").alias("j", "x"))
        full, error = np.zeros((k, k + h.shape[1])), 0.0
        for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("err").alias("err")).collect():  # k (k + d) numbers
            full[r["i"], r["j"]] = r["x"]
            error = max(error, r["err"])
        losses.append(error + lasso * float(np.abs(h).sum()) + 0.5 * ridge * float((h * h).sum()))
        if len(losses) > 1 and losses[-2] - losses[-1] < tol * losses[0]:
            break
        h = penalised(full[:, :k], full[:, k:], lasso, ridge, positive=positive)
    return Fit(h, losses)


def sparse_step(c: np.ndarray, a: np.ndarray, b: np.ndarray, alpha: float, ridge: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One round on a covariance c: (loadings b, d x k; directions a, d x k; the loss before a's step)."""
    b = penalised(c, c @ a, alpha / 2, ridge, begin=b)
    loss = float(np.trace(c) + np.trace(b.T @ c @ b - 2 * a.T @ c @ b) + ridge * (b * b).sum() + alpha * np.abs(b).sum())
    u, _, v = np.linalg.svd(c @ b, full_matrices=False)
    return b, np.where(np.abs(b).sum() > 0, u @ v, a), loss


def unit_rows(b: np.ndarray) -> np.ndarray:
    """Loadings (k x d) of length 1, the largest positive; empty ones stay 0."""
    h = b.T / np.maximum(np.linalg.norm(b, axis=0), 1e-300)[:, None]
    return h * np.where(h[np.arange(len(h)), np.abs(h).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]


def sparse_principal(df: DataFrame, vector: str, k: int, alpha: float = 1.0, ridge: float = 0.01, rounds: int = 200, tol: float = 1e-8) -> Fit:
    """Sparse components: loadings under a lasso, directions by a turn, in rounds on the covariance alone. One pass over the rows."""
    m = moments(df, vector)[None]
    c = m.scatter / max(m.n, 1.0)
    if not len(c):
        return Fit(np.empty((0, 0)), [])
    a, losses = np.linalg.eigh(c)[1][:, ::-1][:, :k], []
    b = a
    for _ in range(rounds):
        b, a, loss = sparse_step(c, a, b, alpha, ridge)
        losses.append(loss)
        if len(losses) > 1 and losses[-2] - losses[-1] < tol * max(losses[0], 1e-300):
            break
    return Fit(unit_rows(b), losses)


def sparse_principal_batches(df: DataFrame, vector: str, k: int, key: str, batches: int = 32, alpha: float = 1.0, ridge: float = 0.01, seed: int = 0) -> Fit:
    """The same learned batch by batch: a round after each, on the covariance of what has come so far. Rows belong to batches by a hash of their key."""
    rows = df.withColumn("__batch", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(batches)))
    found = moments(rows, vector, "__batch")
    a, b, losses, total = None, None, [], None
    for g in sorted(found):
        total = found[g] if total is None else total + found[g]
        c = total.scatter / max(total.n, 1.0)
        a = np.linalg.eigh(c)[1][:, ::-1][:, :k] if a is None else a
        b, a, loss = sparse_step(c, a, a if b is None else b, alpha, ridge)
        losses.append(loss)
    return Fit(np.empty((0, 0)) if b is None else unit_rows(b), losses)


def errors(df: DataFrame, actual: str, made: str) -> DataFrame:
    """One row of what a reconstruction misses: norms, relative error, share of variance about the grand mean, and divergence.

    frob_data, frob_rec, frob_error, rel_error, ss_res, ss_tot, explained_var, kl (values under 1e-10 count as that).
    """
    pair = df.where(F.col(actual).isNotNull() & F.col(made).isNotNull()).select(F.explode(F.arrays_zip(F.col(actual).cast("array<double>").alias("a"), F.col(made).cast("array<double>").alias("b"))).alias("p")).select("p.a", "p.b")
    x, y = F.greatest(F.col("a"), F.lit(EPS)), F.greatest(F.col("b"), F.lit(EPS))
    s = pair.agg(F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.pow(F.col("a") - F.col("b"), 2)).alias("ss_res"), (F.var_pop("a") * F.count("a")).alias("ss_tot"), F.sum(x * F.log(x / y) - x + y).alias("kl"))
    return s.select(F.sqrt("aa").alias("frob_data"), F.sqrt("bb").alias("frob_rec"), F.sqrt("ss_res").alias("frob_error"), F.try_divide(F.sqrt("ss_res"), F.sqrt("aa")).alias("rel_error"), "ss_res", "ss_tot", (1 - F.try_divide("ss_res", "ss_tot")).alias("explained_var"), "kl")


@dataclass(frozen=True)
class Setting:
    sigma: float
    k: int
    rep: int
    shuffled: bool


def fold_parts(df: DataFrame, cell: str, pos: str, n: int, folds: int, sigma: float, value: str) -> DataFrame:
    """(part, fold, cell, pos, value): of each fold the smoothed training rows (part 0), the raw test rows (1) and the smoothed ones (2).

    A training series closes up where the test rows were cut out, and each part is smoothed on its own.
    """
    edges = fold_edges(n, folds, "ceil")
    low, high = (F.array(*[F.lit(e).cast("bigint") for e in es]) for es in (edges[:-1], edges[1:]))
    rows = df.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(folds) if edges[f + 1] > edges[f]]))).withColumns({"__lo": F.get(low, F.col("fold")), "__hi": F.get(high, F.col("fold"))})
    test = F.col(pos).between(F.col("__lo"), F.col("__hi") - 1)
    at = F.when(test, F.col(pos) - F.col("__lo")).when(F.col(pos) >= F.col("__hi"), F.col(pos) - (F.col("__hi") - F.col("__lo"))).otherwise(F.col(pos))
    rows = rows.select(F.when(test, 1).otherwise(0).alias("__t"), "fold", cell, at.alias(pos), value)
    smooth = smoothed(rows, ["__t", "fold", cell], pos, {value: value}, sigma, "even", "reflect")
    out = smooth.select((F.col("__t") * 2).alias("part"), "fold", cell, pos, value)
    return out.unionByName(rows.where("__t = 1").select(F.col("__t").alias("part"), "fold", cell, pos, value))


def normalised_vectors(parts: DataFrame, by: list[str], cell: str, pos: str, value: str, cells: list) -> DataFrame:
    """(by, pos, v): each cell's values less its mean over its deviation within a part (0 where there is none), as vectors in the order of ``cells``."""
    stats = parts.groupBy(*by, cell).agg(F.avg(value).alias("__a"), F.stddev_pop(value).alias("__s"))
    rows = joined(parts, stats, [*by, cell]).withColumn(value, F.coalesce(F.try_divide(F.col(value) - F.col("__a"), F.col("__s")), F.lit(0.0)))
    cols = [F.coalesce(F.max(F.when(F.col(cell) == c, F.col(value))), F.lit(0.0)) for c in cells]
    return rows.groupBy(*by, pos).agg(F.array(*cols).cast("array<double>").alias("v"))


def left_out_matrix(h: np.ndarray) -> np.ndarray:
    """d x d matrix that predicts each place of centred rows from all others and the factors h (k x d), by least squares."""
    gram, out = h @ h.T, np.empty((h.shape[1],) * 2)
    for i, c in enumerate(h.T):
        w = np.linalg.pinv(gram - np.outer(c, c)) @ c  # weights of a row's other places along the factors
        out[:, i] = h.T @ w
        out[i, i] = 0.0
    return out


def missed(m: Moments, predict: np.ndarray, mean: np.ndarray) -> float:
    """Norm of rows less their prediction (x - mean) @ predict + mean, from the rows' moments."""
    d = len(mean)
    move = np.eye(d + 1)
    move[:-1, -1] = m.shift - mean  # moments of (x - mean, 1)
    sums = move @ m.sums @ move.T
    rest = np.eye(d) - predict
    return float(np.sqrt(max(np.trace(rest.T @ sums[:d, :d] @ rest), 0.0)))


def cross_validated(df: DataFrame, cell: str, pos: str, value: str, cells: list, n: int, sigmas: list[float], ks: list[int], folds: int = 5, method: str = "pca", reps: int = 1, shuffle: bool = False, seed: int = 0, rounds: int = 50) -> list[dict]:
    """A row for each (sigma, k, rep, shuffled, fold): the error on training rows, and on test rows with each cell predicted from the others.

    df: (cell, pos, value), positions 0 to n - 1. train_err_sm, test_err, test_err_sm, test_norm and test_norm_sm are
    norms over the number of cells. Errors of test rows follow from the moments of each fold's parts, which one pass
    gathers for all folds of a sigma, and so do components (pca); factors (nmf) of all folds, ks and reps share the
    passes of their rounds. With ``shuffle`` the same once more on cells moved round by shifts of their own.
    """
    if method not in ("pca", "nmf"):
        raise ValueError(f"unknown method {method!r}")
    out, rng = [], np.random.default_rng(seed)
    for shuffled in (False, True) if shuffle else (False,):
        rows = df
        if shuffled:
            rows = df.withColumn(pos, F.pmod(F.col(pos) + F.pmod(F.xxhash64(F.lit(seed), cell), F.lit(n)), F.lit(n)))
        for sigma in sigmas:
            vectors = settled(normalised_vectors(fold_parts(rows, cell, pos, n, folds, sigma, value), ["part", "fold"], cell, pos, value, cells).withColumn("__g", (F.col("fold") * 3 + F.col("part")).cast("bigint")))
            found = moments(vectors, "v", "__g", shift=np.zeros(len(cells)))
            d, models = len(cells), {}
            for f in {g // 3 for g in found}:
                train = found[3 * f]
                if method == "pca":
                    axes = np.linalg.eigh(train.scatter)[1][:, ::-1].T
                    models |= {(f, k, rep): (axes[:k], train.mean, missed(train, axes[:k].T @ axes[:k], train.mean)) for k in ks for rep in range(reps)}
            if method == "nmf":
                # Values are moved to 0 by the least of a fold's training rows, and predictions moved back.
                least = {r["fold"]: r["m"] for r in vectors.where("part = 0").groupBy("fold").agg(F.min(F.array_min("v")).alias("m")).collect()}
                fits, names = {}, []
                for f in sorted(least):
                    for k in ks:
                        for rep in range(reps):
                            fits[len(names)] = start(found[3 * f].mean - least[f], k, int(rng.integers(1 << 31)))
                            names.append((f, k, rep))
                shift = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in (int(kv[0]), float(kv[1]))]), F.col("fold"))
                of = F.element_at(F.create_map(*[x for f in least for x in (F.lit(int(f)), F.array(*[F.lit(g).cast("bigint") for g, nm in enumerate(names) if nm[0] == f]))]), F.col("fold"))
                moved = vectors.where("part = 0").select(of.alias("g"), F.transform("v", lambda x: x - shift).alias("v"))
                got = non_negative(moved, "v", fits, "g", rounds=rounds, inner=30)
                models = {nm: (got[g].h, np.full(d, least[nm[0]]), float(np.sqrt(2 * got[g].losses[-1]))) for g, nm in enumerate(names)}
            for (f, k, rep), (h, mean, train_err) in sorted(models.items(), key=lambda kv: kv[0]):
                predict, none = left_out_matrix(h), np.zeros(d)
                row = {"sigma": float(sigma), "k": k, "rep": rep, "shuffled": shuffled, "fold": f, "train_err_sm": train_err / d}
                for name, part in (("test_err", 1), ("test_err_sm", 2)):
                    row[name] = missed(found[3 * f + part], predict, mean) / d
                    row[name.replace("err", "norm")] = missed(found[3 * f + part], np.zeros((d, d)), none) / d
                out.append(row)
    return out


def scored(df: DataFrame, vector: str, fit: Fit, keys: list[str], loss: str = "frobenius", inner: int = 50) -> DataFrame:
    """(keys, weights, vector): each row's weights for a fit's factors, and what they make."""

    def made(v, _):
        w = row_weights(clean(v, loss), fit.h, loss, inner)
        return {"weights": w, "vector": w @ fit.h}

    return mapped(df, vector, {"weights": "array<double>", "vector": "array<double>"}, made, keys)
