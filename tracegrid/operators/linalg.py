"""Linear models from second moments: one pass over the rows, then a small solve on the driver.

Rows hold a vector column (array of doubles). Each task adds up the outer products of its rows; what reaches the driver
is one (d + 1) x (d + 1) matrix for each fold or class, whatever the number of rows. Rows are first moved by a shift, the
mean of SHIFT of them, so that a mean far from zero costs no digits: with m rows of all n, the square of what is left of
the mean is at most n / m of the variance, as those m rows are part of it.

Rows with a NULL vector don't count; vectors of different lengths are an error; a NULL or NaN place makes the sums it
enters NaN; repeated rows count each time. An empty table has moments of 0 and models of no places: principal gives no
components, correlations a 0 x 0 matrix, factorised factors of no places, residual no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.settle import settled


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; vectors of different lengths are an error, a NULL place is NaN."""
    if len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("vectors of different lengths")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


#: Rows whose mean all rows are moved by before they are multiplied.
SHIFT = 1000


@dataclass(frozen=True)
class Moments:
    """What the sum of (v - shift, 1)(v - shift, 1)^T stands for: mean, covariance sums and count. Those of one shift add and subtract."""

    sums: np.ndarray
    shift: np.ndarray

    @property
    def n(self) -> float:
        return float(self.sums[-1, -1])

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.sums[:-1, -1] / max(self.n, 1.0)

    @property
    def scatter(self) -> np.ndarray:
        rest = self.sums[:-1, -1] / max(self.n, 1.0)
        return self.sums[:-1, :-1] - self.n * np.outer(rest, rest)

    @property
    def raw(self) -> np.ndarray:
        """The sum of (v, 1)(v, 1)^T."""
        back = np.eye(len(self.sums))
        back[:-1, -1] = self.shift
        return back @ self.sums @ back.T

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.sums + other.sums, self.shift)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.sums - other.sums, self.shift)

    def part(self, places: list[int]) -> Moments:
        """Those of some of the vector's places."""
        keep = [*places, len(self.sums) - 1]
        return Moments(self.sums[np.ix_(keep, keep)], self.shift[places])


def first_mean(rows: DataFrame, vector: str) -> np.ndarray:
    """Mean of SHIFT rows, 0 where it isn't finite."""
    some = [np.array([np.nan if x is None else x for x in r[0]], dtype=np.float64) for r in rows.select(vector).limit(SHIFT).collect()]
    if len({len(v) for v in some}) > 1:
        raise ValueError("vectors of different lengths")
    with np.errstate(invalid="ignore", over="ignore"):
        mean = np.mean(some, axis=0) if some else np.empty(0)
    return np.where(np.isfinite(mean), mean, 0.0)


def moments(df: DataFrame, vector: str, group: str | None = None, weight: str | None = None, shift: np.ndarray | None = None) -> dict:
    """group -> Moments of its rows; without ``group`` the only key is None. Rows with a NULL vector don't count.

    shift: another than the first rows' mean, as for moments that are to be added to others.
    """
    rows = df.where(F.col(vector).isNotNull())
    rows = rows.select((F.col(group) if group else F.lit(0)).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    by = first_mean(rows, "v") if shift is None else shift

    def run(batches):
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1))
            if v.shape[1] != len(by):
                raise ValueError("vectors of different lengths")
            v = np.hstack([v - by, np.ones((len(v), 1))])
            w = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), dtype=np.float64)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(keys):
                mine = keys == k
                part = (v[mine] * w[mine, None]).T @ v[mine]
                sums[int(k)] = sums.get(int(k), 0) + part
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(s), pa.int64()), pa.array(range(len(s)), pa.int64()), pa.array([r.tobytes() for r in s], pa.binary())], ["k", "i", "row"])

    def total(batches):  # as many rows of each (k, i) as the pass has tasks, added up as they come
        held: dict = {}
        for batch in batches:
            for k, i, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[k, i] = held.get((k, i), 0.0) + np.frombuffer(row)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([i for _, i in held], pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], ["k", "i", "row"])

    kind = "k bigint, i bigint, row binary"
    found = rows.mapInArrow(run, kind).repartition("k", "i").mapInArrow(total, kind).collect()  # d + 1 rows of d + 1 numbers a group
    size = len(by) + 1
    out: dict = {} if group else {None: Moments(np.zeros((size, size)), by)}
    for r in found:
        out.setdefault(r["k"] if group else None, Moments(np.zeros((size, size)), by)).sums[r["i"]] = np.frombuffer(r["row"])
    return out


def mapped(df: DataFrame, vector: str, outs: dict[str, str], function, keys: list[str]) -> DataFrame:
    """(keys, outs): function(matrix of the rows' vectors, key columns as arrays) -> a dict of arrays, a batch at a time."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), *(f"{k} {t}" for k, t in outs.items())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(i) for i in range(len(keys))]
                made = function(matrix(batch.column(len(keys))), {k: c.to_numpy(zero_copy_only=False) for k, c in zip(keys, columns, strict=True)})
                kind = {"double": pa.float64(), "bigint": pa.int64(), "array<double>": pa.list_(pa.float64())}
                arrays = [pa.array(v.tolist() if v.ndim > 1 else v, kind[outs[k]]) for k, v in made.items()]
                yield pa.RecordBatch.from_arrays([*columns, *arrays], [*keys, *made])

    return df.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("__v")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Components:
    """Principal components: loadings (k x d), mean and variances, greatest first; the largest loading of each is positive."""

    loadings: np.ndarray
    mean: np.ndarray
    variances: np.ndarray

    @property
    def ratios(self) -> np.ndarray:
        return self.variances / max(self.variances.sum(), 1e-300)


def principal(df: DataFrame, vector: str, k: int | None = None) -> Components:
    m = moments(df, vector)[None]
    if not len(m.mean):
        return Components(np.empty((0, 0)), m.mean, np.empty(0))
    values, vectors = np.linalg.eigh(m.scatter / max(m.n - 1, 1.0))
    order = np.argsort(-values)
    loadings = vectors[:, order].T
    signs = np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])
    return Components((loadings * signs[:, None])[:k], m.mean, np.maximum(values[order], 0.0))


def scores(df: DataFrame, vector: str, found: Components, keys: list[str], k: int | None = None) -> DataFrame:
    """(keys, scores): centred vectors along the first k components; a prefix of the scores is an embedding of its own."""
    take, mean = found.loadings[:k].T, found.mean
    return mapped(df, vector, {"scores": "array<double>"}, lambda v, _: {"scores": (v - mean) @ take}, keys)


def rebuilt(df: DataFrame, score: str, found: Components, keys: list[str], k: int) -> DataFrame:
    """(keys, vector) from the first k scores."""
    take, mean = found.loadings[:k], found.mean
    return mapped(df, score, {"vector": "array<double>"}, lambda s, _: {"vector": s[:, :k] @ take + mean}, keys)


def components_for(share: float, found: Components) -> int:
    """The least k whose components hold at least ``share`` of the variance."""
    return int(min(np.searchsorted(np.cumsum(found.ratios), share - 1e-12) + 1, len(found.variances)))


def correlations(df: DataFrame, vector: str) -> np.ndarray:
    """d x d correlation of the vector's places; NaN where one is constant."""
    s = moments(df, vector)[None].scatter
    d = np.sqrt(np.diag(s))
    with np.errstate(divide="ignore", invalid="ignore"):
        return s / np.outer(d, d)


def mean_correlation(corr: np.ndarray) -> np.ndarray:
    """Mean correlation of each place with all others, NaN left out."""
    c = corr.copy()
    np.fill_diagonal(c, np.nan)
    return np.nanmean(c, axis=1)


def residual(df: DataFrame, x: str, b: str, keys: list[str], alpha: float = 1e-3) -> DataFrame:
    """(keys, vector): x minus what a ridge model with intercept predicts from b."""
    dims = df.select(F.size(x), F.size(b)).first()
    if dims is None:
        return df.select(*keys, F.col(x).cast("array<double>").alias("vector"))
    both = df.withColumn("__xb", F.concat(F.col(b).cast("array<double>"), F.col(x).cast("array<double>")))
    m, nb = moments(both, "__xb")[None], dims[1]
    w = np.linalg.solve(m.scatter[:nb, :nb] + alpha * np.eye(nb), m.scatter[:nb, nb:])
    offset = m.mean[nb:] - m.mean[:nb] @ w
    return mapped(both, "__xb", {"vector": "array<double>"}, lambda v, _: {"vector": v[:, nb:] - v[:, :nb] @ w - offset}, keys)


def procrustes(df: DataFrame, a: str, b: str) -> float:
    """Disparity of two sets of points after centring, scaling and the best turn: 1 - (sum of singular values)^2."""
    row = df.select(F.size(a)).first()
    if row is None:
        return float("nan")
    m, n = moments(df.withColumn("__ab", F.concat(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"))), "__ab")[None], row[0]
    s = m.scatter
    scale = np.sqrt(np.trace(s[:n, :n]) * np.trace(s[n:, n:]))
    return float(1 - (np.linalg.svd(s[:n, n:], compute_uv=False).sum() / scale) ** 2)


def canonical(df: DataFrame, x: str, y: str, k: int, ridge: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(correlations, weights of x, weights of y) of the first k canonical pairs, from covariance blocks."""
    row = df.select(F.size(x)).first()
    if row is None:
        return np.empty(0), np.empty((0, 0)), np.empty((0, 0))
    nx = row[0]
    m = moments(df.withColumn("__xy", F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>"))), "__xy")[None]
    s = m.scatter / m.n
    root = lambda c: np.linalg.inv(np.linalg.cholesky(c + ridge * np.eye(len(c))))
    rx, ry = root(s[:nx, :nx]), root(s[nx:, nx:])
    u, r, v = np.linalg.svd(rx @ s[:nx, nx:] @ ry.T)
    return r[:k], rx.T @ u[:, :k], ry.T @ v[:k].T


def partial_least_squares(sums: Moments, nx: int, k: int) -> np.ndarray:
    """Coefficients (x -> y, both centred and scaled) of k-component PLS, by deflating covariance blocks."""
    s = sums.scatter / sums.n
    d = np.sqrt(np.where(np.diag(s) > 0, np.diag(s), 1.0))
    s = s / np.outer(d, d)
    xx, xy = s[:nx, :nx], s[:nx, nx:]
    weights, loads, targets = [], [], []
    left = xy.copy()
    for _ in range(min(k, nx)):
        w = np.linalg.svd(left, full_matrices=False)[0][:, 0]
        for p, prior in zip(loads, weights, strict=True):
            w = w - prior * (p @ w)
        t2 = w @ xx @ w
        if t2 < 1e-14:
            break
        p, q = xx @ w / t2, xy.T @ w / t2
        weights.append(w)
        loads.append(p)
        targets.append(q)
        left = left - np.outer(p, q) * t2
    return np.array(weights).T @ np.array(targets) if weights else np.zeros((nx, s.shape[0] - nx))


def factorised(df: DataFrame, vector: str, k: int, rounds: int = 30, inner: int = 20, clamp: np.ndarray | None = None, ridge: float = 0.0, seed: int = 0, tol: float = 0.0) -> tuple[np.ndarray, list[float]]:
    """Non-negative factors H (k x d), and the squared error after each round. Negative values count as zero.

    A row's weights depend on H and the row alone, so they are solved where the row lies, by multiplicative steps from
    a fixed start; one pass adds up what H's update needs. ``clamp``: leading rows of H that stay as they are. tol: rounds
    end when the error falls by less than this share of the first.
    """
    shape = moments(df.withColumn("__p", F.transform(vector, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))), "__p")[None]
    rng = np.random.default_rng(seed)
    h = np.abs(rng.normal(1.0, 0.5, size=(k, len(shape.mean)))) * (shape.mean + 1e-9)
    fixed = 0 if clamp is None else len(clamp)
    if fixed:
        h[:fixed] = clamp
    errors: list[float] = []
    rows = settled(df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")))
    for _ in range(rounds):
        now = h

        def part(batches, now=now):
            ww, wx, err = 0.0, 0.0, 0.0
            for batch in batches:
                if batch.num_rows:
                    x = np.maximum(matrix(batch.column(0)), 0.0)
                    w = row_weights(x, now, inner, ridge)
                    ww, wx, err = ww + w.T @ w, wx + w.T @ x, err + float(((x - w @ now) ** 2).sum())
            if not np.isscalar(ww):
                yield pa.RecordBatch.from_arrays([pa.array(list(range(len(now))), pa.int64()), pa.array(np.hstack([ww, wx]).tolist(), pa.list_(pa.float64())), pa.array([err] + [0.0] * (len(now) - 1))], ["i", "row", "err"])

        parts = rows.mapInArrow(part, "i bigint, row array<double>, err double")
        cells = parts.select("i", "err", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("err").alias("err")).collect()  # k (k + d) numbers
        full = np.zeros((k, k + h.shape[1]))
        for r in cells:
            full[r["i"], r["j"]] = r["x"]
        errors.append(max((r["err"] for r in cells), default=0.0))
        step = full[:, k:] / np.maximum(full[:, :k] @ h, 1e-12)
        h = np.where(np.arange(k)[:, None] < fixed, h, h * step)
        if tol and len(errors) > 1 and errors[-2] - errors[-1] < tol * errors[0]:
            break
    return h, errors


def row_weights(x: np.ndarray, h: np.ndarray, inner: int = 20, ridge: float = 0.0) -> np.ndarray:
    """Non-negative weights of rows for factors h."""
    xh, hh = x @ h.T, h @ h.T + ridge * np.eye(len(h))
    w = np.full_like(xh, 1.0) * (x.mean(axis=1, keepdims=True) / max(h.mean() * len(h), 1e-12) + 1e-9)
    for _ in range(inner):
        w = w * xh / np.maximum(w @ hh, 1e-12)
    return w


def left_out(df: DataFrame, vector: str, loadings: np.ndarray, offset: np.ndarray, keys: list[str]) -> DataFrame:
    """(keys, vector): each place predicted, by least squares, from all other places and the loadings (k x d)."""
    gram = loadings @ loadings.T
    b = np.stack([np.linalg.pinv(gram - np.outer(c, c)) @ c for c in loadings.T], axis=1)
    own = (loadings * b).sum(axis=0)

    def predict(v, _):
        x = v - offset
        return {"vector": (x @ loadings.T) @ b - x * own + offset}

    return mapped(df, vector, {"vector": "array<double>"}, predict, keys)


def assigned(gain: np.ndarray) -> list[int]:
    """For each row of a square matrix a column of its own, so that the gains' sum is greatest; improved by swaps along
    shortest paths of reduced costs, row after row."""
    cost = gain.max() - gain
    n = len(cost)
    row_price, col_price, owner = np.zeros(n), np.zeros(n), np.full(n, -1)
    for r in range(n):
        reach, back, seen = cost[r] - row_price[r] - col_price, np.full(n, -1), np.zeros(n, dtype=bool)
        while True:
            open_ = np.where(seen, np.inf, reach)
            c = int(open_.argmin())
            low = open_[c]
            seen[c] = True
            if owner[c] < 0:
                break
            more = low + cost[owner[c]] - row_price[owner[c]] - col_price
            better = ~seen & (more < reach)
            reach, back = np.where(better, more, reach), np.where(better, c, back)
        for j in np.flatnonzero(seen):
            if j != c:
                row_price[owner[j]] += low - reach[j]
                col_price[j] -= low - reach[j]
        row_price[r] += low
        while back[c] >= 0:
            owner[c], c = owner[back[c]], int(back[c])
        owner[c] = r
    return [int(np.flatnonzero(owner == r)[0]) for r in range(n)]
