"""Groups of cells by distance: agglomerative clusters with the order of their leaves, and exact one-dimensional k-means.

Cells are the places of a vector column. What a pair of cells has in common is a sum over rows, so the cell by cell table
is added up where the rows lie (``pair_table``) and one table of cells x cells reaches the driver; cells are meant to be
some thousands at most, whatever the number of rows. Merging follows chains of nearest neighbours, which needs no more
than that table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.ensembles import correlated_cells, projected
from tracegrid.operators.linalg import matrix, moments
from tracegrid.operators.ordered import positions, running
from tracegrid.operators.settle import settled


def pair_table(df: DataFrame, vector: str, made) -> np.ndarray:
    """Sum over rows of made(v): a places x places array for a matrix of rows."""

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = made(matrix(batch.column(0).slice(at, 256)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    parts = rows.mapInArrow(run, "i bigint, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # places squared
    out = np.zeros((1 + max((r["i"] for r in parts), default=-1),) * 2)
    for r in parts:
        out[r["i"], r["j"]] = r["x"]
    return out


def _xlogx(p: np.ndarray) -> np.ndarray:
    return p * np.log(np.where(p > 0, p, 1.0))


def distances(df: DataFrame, vector: str, metric: str = "euclidean") -> np.ndarray:
    """Cell x cell distances of the cells' columns of values: euclidean, cosine, correlation, kl (both ways added up) or jsd.

    kl and jsd take a cell's values as shares of their sum; negative ones count as 0, and kl adds 1e-12 to every share.
    """
    if metric in ("euclidean", "correlation", "cosine"):
        if metric == "euclidean":
            return np.sqrt(np.maximum(pair_table(df, vector, _squares), 0.0))
        m = moments(df, vector)[None]
        gram = m.scatter if metric == "correlation" else m.raw[:-1, :-1]
        size = np.diag(gram)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1 - gram / np.sqrt(np.outer(size, size))
        out = np.where(np.isfinite(out), np.maximum(out, 0.0), 1.0)
    elif metric in ("kl", "jsd"):
        total = df.where(F.col(vector).isNotNull()).select(F.posexplode(F.transform(vector, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))).alias("j", "x")).groupBy("j").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("j").collect()  # a row for each place
        sums = np.array([r["s"] or 1.0 for r in total])
        n = total[0]["n"] if total else 0

        def kl(v):
            p = (np.maximum(v, 0) / sums + 1e-12) / (1 + n * 1e-12)
            cross = p.T @ np.log(p)
            own = np.diag(cross)
            return own[:, None] + own[None, :] - cross - cross.T

        def jsd(v):
            p = np.maximum(v, 0) / sums
            own = _xlogx(p).sum(axis=0)
            mid = np.stack([_xlogx((p + p[:, [j]]) / 2).sum(axis=0) for j in range(p.shape[1])])
            return (own[:, None] + own[None, :]) / 2 - mid

        out = np.maximum(pair_table(df, vector, kl if metric == "kl" else jsd), 0.0)
        out = np.sqrt(out) if metric == "jsd" else out
    else:
        raise ValueError(f"unknown metric {metric!r}")
    np.fill_diagonal(out, 0.0)
    return (out + out.T) / 2


def _squares(v: np.ndarray) -> np.ndarray:
    """Squared differences of places, from products of rows less their mean, which no difference sees."""
    v = v - v.mean(axis=1, keepdims=True)
    size = (v * v).sum(axis=0)
    return size[:, None] + size[None, :] - 2 * v.T @ v


def linkage(dist: np.ndarray, method: str = "ward") -> np.ndarray:
    """Merges (a, b, height, size) by rising height; ids below n are cells, n + k is what merge k made.

    method: ward (of euclidean distances), average, complete or single. A chain of nearest neighbours is followed until
    two clusters are each other's; of equals the earlier one of the chain, else the least, is the nearest.
    """
    if method not in ("ward", "average", "complete", "single"):
        raise ValueError(f"unknown method {method!r}")
    n = len(dist)
    d = np.array(dist, dtype=np.float64)
    d = d * d if method == "ward" else d
    np.fill_diagonal(d, np.inf)
    size, live, merges, chain = np.ones(n), np.ones(n, dtype=bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        a = chain[-1]
        row = np.where(live, d[a], np.inf)
        b = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            lo, hi = min(a, b), max(a, b)
            merges.append((lo, hi, row[b]))
            x, y, na, nb = d[lo], d[hi], size[lo], size[hi]
            if method == "ward":
                new = ((na + size) * x + (nb + size) * y - size * row[b]) / (na + nb + size)
            else:
                new = {"average": (na * x + nb * y) / (na + nb), "complete": np.maximum(x, y), "single": np.minimum(x, y)}[method]
            live[lo] = False
            new[~live] = np.inf
            new[hi] = np.inf
            d[hi], d[:, hi], size[hi] = new, new, na + nb
        else:
            chain.append(b)
    # A cluster stands in the place of its later cell; in order of height these become ids.
    ids, out = {k: (k, 1) for k in range(n)}, np.zeros((max(0, n - 1), 4))
    for k, (lo, hi, h) in enumerate(sorted(merges, key=lambda m: m[2])):
        (a, na), (b, nb) = ids[_top(ids, lo)], ids[_top(ids, hi)]
        out[k] = (min(a, b), max(a, b), np.sqrt(max(h, 0.0)) if method == "ward" else h, na + nb)
        ids[_top(ids, lo)] = _top(ids, hi)
        ids[_top(ids, hi)] = (n + k, na + nb)
    return out


def _top(ids: dict, k: int) -> int:
    while not isinstance(ids[k], tuple):
        k = ids[k]
    return k


def labelled(merges: np.ndarray, clusters: int) -> list[int]:
    """A label from 1 for each cell when the last merges are undone until there are ``clusters``; numbered by their first cells."""
    n = len(merges) + 1
    parent = list(range(2 * n - 1))
    for k, (a, b, *_) in enumerate(merges[: max(0, n - max(1, clusters))]):
        parent[int(a)] = parent[int(b)] = n + k

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    seen: dict[int, int] = {}
    return [seen.setdefault(root(k), len(seen) + 1) for k in range(n)]


def leaf_order(merges: np.ndarray) -> list[int]:
    """Cells as a tree of the merges shows them: of two branches the one that was merged lower first, of equals the one with the lesser id."""
    n = len(merges) + 1
    height = lambda k: 0.0 if k < n else merges[k - n][2]
    open_, out = [2 * n - 2] if n > 1 else [0], []
    while open_:
        k = open_.pop()
        if k < n:
            out.append(k)
        else:
            a, b = sorted((int(merges[k - n][0]), int(merges[k - n][1])), key=lambda c: (height(c), c))
            open_ += [b, a]
    return out


def clustered(df: DataFrame, vector: str, clusters: int, method: str = "ward", metric: str = "euclidean") -> tuple[list[int], list[int]]:
    """(label of each cell, cells in the order of leaves); ward of another metric than euclidean becomes average."""
    dist = distances(df, vector, metric)
    if not len(dist):
        return [], []
    merges = linkage(dist, "average" if method == "ward" and metric != "euclidean" else method)
    return labelled(merges, clusters), leaf_order(merges)


def extract_clusters(rows: DataFrame, shuffled: list[DataFrame], vector: str, loadings: DataFrame, scores: DataFrame, clusters: int, frame: str = "frame", percent: float = 95.0, method: str = "ward", metric: str = "euclidean", sigma: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(cell, cluster) of all cells and (cluster, frame, score, active), for rows of cells' values, loadings (comp, cell, value) and scores (comp, frame, value).

    Cells whose mean correlation exceeds that of the shuffled rows are put into ``clusters`` groups by their loadings, into
    one if they are fewer; the others have cluster 0. Cells are places of the vector, from 0.
    """
    n = rows.select(F.size(vector)).first()
    some = correlated_cells(rows, shuffled, vector, percent)
    label = dict.fromkeys(range(n[0] if n else 0), 0)
    if some and len(some) >= clusters:
        keep = F.array(*[F.lit(c) for c in some])
        wide = loadings.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("cell", "value"))).alias("__m"))  # a component's cells
        wide = wide.select(F.transform(keep, lambda c: F.coalesce(F.try_element_at("__m", c.cast("bigint")), F.lit(0.0))).alias("v"))
        label |= dict(zip(some, clustered(wide, "v", clusters, method, metric)[0], strict=True))
    else:
        label |= dict.fromkeys(some, 1)
    cells = rows.sparkSession.createDataFrame([(int(c), int(k)) for c, k in label.items()], "cell bigint, cluster bigint")
    return cells, projected(loadings, scores, cells.where("cluster > 0"), "comp", "cell", frame, "value", sigma)


#: Distinct values up to which any number of levels is found on the driver.
MOST_VALUES = 200_000


def levels(df: DataFrame, value: str, k: int = 2, most: int = MOST_VALUES) -> list[float]:
    """The k means with the least sum of squares, rising; exact, by dynamic programming over counted values.

    Two levels are found where the rows lie, however many values there are (``two_levels``). Fewer distinct values than
    levels give one level each. More than ``most`` distinct values with more than two levels are an error.
    """
    counts = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)").groupBy("x").agg(F.count("*").alias("n"))
    if k == 2:
        return two_levels(counts)
    rows = counts.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct values; round them first")
    rows.sort(key=lambda r: r["x"])
    x, w = np.array([r["x"] for r in rows]), np.array([r["n"] for r in rows], dtype=np.float64)
    if len(x) <= k:
        return x.tolist()
    x0 = np.average(x, weights=w)
    s0, s1, s2 = (np.append(0.0, np.cumsum(w * (x - x0) ** p)) for p in range(3))
    cost = lambda i, j: s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / (s0[j] - s0[i])  # noqa: E731  of the values i to j - 1
    n = len(x)
    best = np.append(0.0, [cost(0, j) for j in range(1, n + 1)])
    cuts = []
    for level in range(1, k):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        todo = [(level + 1, n, level, n - 1)]
        while todo:  # the best cut never moves left as the end moves right
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(left, min(right, mid - 1) + 1)
            total = best[i] + cost(i, mid)
            at = int(total.argmin())
            now[mid], cut[mid] = total[at], i[at]
            todo += [(lo, mid - 1, left, int(i[at])), (mid + 1, hi, int(i[at]), right)]
        best = now
        cuts.append(cut)
    ends = [n]
    for cut in reversed(cuts):
        ends.append(int(cut[ends[-1]]))
    ends = [0, *sorted(ends)]
    return [float(x0 + (s1[b] - s1[a]) / (s0[b] - s0[a])) for a, b in zip(ends, ends[1:], strict=False)]


def two_levels(counts: DataFrame) -> list[float]:
    """The two means of values (x, n): the cut with the least sum of squares, from running sums along ranges of values."""
    counts = settled(counts)
    whole = counts.agg(F.count("*").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("n"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m")).collect()[0]
    if whole["k"] <= 2:
        return sorted(r["x"] for r in counts.select("x").collect())
    rows = positions(counts, [], "x", [], "__p", (whole["hi"] - whole["lo"]) / 64 or None)
    rows = running(rows, [], "__p", {"__n": F.col("n"), "__s": (F.col("x") - whole["m"]) * F.col("n")})
    # What two groups leave is least where the sums between them are greatest.
    right = F.lit(whole["n"]) - F.col("__n")
    gain = F.col("__s") * F.col("__s") / F.col("__n") + F.col("__s") * F.col("__s") / right
    top = rows.where(right > 0).agg(F.max_by(F.struct("__n", "__s"), F.struct(gain, -F.col("__p"))).alias("b")).collect()[0]["b"]
    return [whole["m"] + top["__s"] / top["__n"], whole["m"] - top["__s"] / (whole["n"] - top["__n"])]


def nearest_level(value: Column, found: list[float]) -> Column:
    """Which level a value belongs to, from 0; in the middle between two the lower one."""
    cuts = [(a + b) / 2 for a, b in zip(found, found[1:], strict=False)]
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)

