"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree cuts the unit sphere by random directions, level by level; a vector within the spill of a cut goes to both
sides. Cuts are medians of a bounded sample: of the sample's vectors in the node, and where a node is too deep to have
enough of them, of those in its last ancestor that has. Every vector is indexed.

Vectors that share a leaf of any tree are compared in two steps. First come ids with a sketch of signs along SIGNS
random directions, and only vectors whose sketch is near another one of their leaf are sent for; a pair at the wanted
cosine is farther apart than the limit once in a hundred million. These are compared in double precision; what passes is
a link.

Equal vectors are one class from the start, so copies meet as one row. A leaf with many vectors, as of near copies, is
dealt out as pairs of parts. A pair that shares several leaves is counted in the first of them only, so links are
counted without being listed; only a spanning forest of each leaf's links goes on to find components.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null id, link
with nothing; vectors of different lengths don't link; each row of a repeated id counts as a vector of its own, under
that id; ties in cosine make no difference; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.components import components
from tracegrid.llm.shared import finite, forest, settled

COSINE, TREES, SEED = 0.95, 6, 20
#: Vectors, and bytes of them, that set the cuts; of these at least so many for a node's own median.
SAMPLE, SAMPLE_BYTES, LEAST = 20_000, 64 << 20, 40
#: Vectors that a leaf is meant to hold, before spill; vectors in a part of a large leaf.
LEAF, PART = 256, 1024
#: A node's direction is one of this many of its level; signs in a sketch.
SLOTS, SIGNS = 16, 128
#: A node of which a greater share would go to both sides, as in a cluster of near copies, is not cut.
DOUBLED = 0.35


class Forest:
    """Directions and cuts of all trees; picklable, and no larger for more vectors but for its depth."""

    def __init__(self, sample: np.ndarray, vectors: int, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        dim = sample.shape[1]
        self.depth = max(0, math.ceil(math.log2(max(1, vectors) / leaf)))
        own = min(self.depth, max(0, int(math.log2(max(1, len(sample) / LEAST)))))  # levels whose nodes have medians of their own
        # Half the standard deviation, over random directions, of the distance that a linked pair may have along one.
        self.spill = 0.5 * math.sqrt(2 - 2 * cosine) / math.sqrt(dim)
        rng = np.random.default_rng([seed, 1 << 20])
        self.signs = rng.normal(size=(SIGNS, dim))
        turned = math.acos(cosine) / math.pi  # chance that a sign differs for a pair at the cosine
        self.apart = math.ceil(SIGNS * turned + 5.7 * math.sqrt(SIGNS * turned * (1 - turned)))
        self.trees = []
        for tree in range(trees):
            rng, levels = np.random.default_rng([seed, tree]), []
            node = np.zeros(len(sample), dtype=np.int64)
            for level in range(self.depth):
                directions = rng.normal(size=(min(1 << level, SLOTS), dim))
                directions /= np.linalg.norm(directions, axis=1, keepdims=True)
                deep = max(0, level - own)
                at = sample @ directions.T
                order = np.argsort(node, kind="stable")
                cuts = np.tile(np.median(at, axis=0), (1 << level - deep, 1))
                for mine in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    cut = np.median(at[mine], axis=0)
                    doubled = (np.abs(at[mine] - cut) <= self.spill).mean(axis=0)
                    cuts[node[mine[0]]] = np.where(doubled <= DOUBLED, cut, np.inf)
                levels.append((directions, cuts, deep))
                if level < own:
                    slot = node % len(directions)
                    node = 2 * node + (at[np.arange(len(at)), slot] > cuts[node, slot])
            self.trees.append(levels)

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors, each with all its leaves; a leaf's number holds its tree's."""
        found = []
        for tree, levels in enumerate(self.trees):
            row, node = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
            for directions, cuts, deep in levels:
                slot = node % len(directions)
                at = (unit @ directions.T)[row, slot] - cuts[node >> deep, slot]
                left, right = at <= self.spill, at >= -self.spill
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            found.append((row, node + (tree << 48)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        """Rows of 64-bit words, a bit for each sign."""
        return np.packbits(unit @ self.signs.T > 0, axis=1).view("<u8")


def usable(vector: str):
    """True for vectors that may link."""
    return finite(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def units(raw: np.ndarray) -> np.ndarray:
    """Rows at length 1. Their largest component is brought to 1 first, as squares of tiny or huge ones leave the doubles."""
    some = raw / np.abs(raw).max(axis=1, keepdims=True)
    return some / np.linalg.norm(some, axis=1, keepdims=True)


def _shared_before(row: np.ndarray, code: np.ndarray, rows: int, leaf: int) -> np.ndarray:
    """0/1 matrix of rows by leaves with a lower number than ``leaf`` that they lie in."""
    lower = code < leaf
    place, at = np.unique(code[lower], return_inverse=True)
    of = np.zeros((rows, max(1, len(place))), dtype=np.float32)
    of[row[lower], at] = 1
    return of


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of both sides of a pair of parts, or all rows twice for a part with itself."""
    two = bool(side.any())
    a, b = (np.flatnonzero(side == s) if two else np.arange(len(side)) for s in (1, 2))
    return a, b, two


def links(classes: DataFrame, dim: int, cosine: float = COSINE, **how) -> DataFrame:
    """(id, links, to) from classes (id, h, copies, v) of one length: parts of link counts, and links enough to connect."""
    rows = classes.count()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(most).select("v").toPandas()["v"]  # SAMPLE_BYTES at most
    sample = np.array([np.asarray(v, dtype=np.float64) for v in sample]).reshape(-1, dim)
    trees = Forest(units(sample), rows, cosine, **how)
    shared = classes.sparkSession.sparkContext.broadcast(trees)  # a few MB, whatever the number of vectors

    def unit_of(column) -> np.ndarray:
        return units(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                unit = unit_of(part.column(2))
                row, leaf = shared.value.leaves(unit)
                words = shared.value.sketches(unit).view("<i8")[row]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), part.column(0).take(take), part.column(1).take(take), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], ["leaf", "id", "h", "s1", "s2"])

    dealt = settled(classes.select("id", "h", "v").mapInArrow(index, "leaf bigint, id bigint, h bigint, s1 bigint, s2 bigint"))
    sizes = settled(dealt.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    met = dealt.join(sizes, "leaf").withColumns({"parts": parts, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "id", "h", "s1", "s2")

    def near(table: pa.Table) -> pa.Table:
        a, b, two = _sides(table.column("side").to_numpy())
        words = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")])
        busy = np.zeros(table.num_rows, dtype=bool)
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            close = sum(np.bitwise_count(w[some, None] ^ w[None, b]).astype(np.int16) for w in words) <= shared.value.apart
            if not two:
                close[np.arange(len(some)), some] = False
            busy[some] |= close.any(axis=1)
            busy[b] |= close.any(axis=0)
        return table.select(["leaf", "i", "j", "side", "id", "h"]).filter(pa.array(busy))

    asked = met.groupBy("leaf", "i", "j").applyInArrow(near, "leaf bigint, i int, j int, side int, id bigint, h bigint")
    # Vectors move once for each leaf part in which they may have a link.
    sent = asked.join(classes.select("id", "h", "copies", "v"), ["id", "h"])

    def compare(table: pa.Table) -> pa.Table:
        side, ids, copies = (table.column(c).to_numpy() for c in ("side", "id", "copies"))
        unit = unit_of(table.column("v").combine_chunks())
        a, b, two = _sides(side)
        alike = unit[a] @ unit[b].T >= cosine
        if not two:
            np.fill_diagonal(alike, False)
        x, y = np.nonzero(alike)
        if not len(x):
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        busy, at = np.unique(np.concatenate([a[x], b[y]]), return_inverse=True)
        row, code = shared.value.leaves(unit[busy])
        of = _shared_before(row, code, len(busy), table.column("leaf")[0].as_py())
        p, q = at[: len(x)], at[len(x) :]
        first = ~((of @ of.T > 0)[p, q])
        count = np.zeros(len(busy), dtype=np.int64)
        np.add.at(count, p[first], copies[busy[q[first]]])
        if two:  # the other half of a part with itself stands in alike already
            np.add.at(count, q[first], copies[busy[p[first]]])
        node, root = forest(ids[a[x]], ids[b[y]])
        some = count > 0
        return pa.table({"id": pa.array(np.concatenate([ids[busy[some]], node]), pa.int64()), "links": pa.array(np.concatenate([count[some], np.zeros(len(node), dtype=np.int64)]), pa.int64()), "to": pa.array([None] * int(some.sum()) + root.tolist(), pa.int64())})

    return sent.groupBy("leaf", "i", "j").applyInArrow(compare, "id bigint, links bigint, to bigint")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, **how) -> DataFrame:
    """(key, n_links, component_id, kept) for every row; kept is true for the least id of a component."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", usable("v") & F.col("key").isNotNull())
    good = rows.where("ok").select("key", "v", F.xxhash64("v").alias("h"))
    classes = settled(good.groupBy("h", "v").agg(F.min("key").alias("id"), F.count("*").alias("copies")))
    found = None
    for dim in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):
        one = links(classes.where(F.size("v") == dim), dim, cosine, **how)
        found = one if found is None else found.unionByName(one)
    none = df.sparkSession.createDataFrame([], "id bigint, links bigint, to bigint")
    found = settled(found if found is not None else none)
    counts = found.groupBy("id").agg(F.sum("links").alias("more"))
    # Classes are named by ids, and an id may name two: vectors that share an id are one node.
    of = components(found.where(F.col("to").isNotNull()).select(F.col("id").alias("a"), F.col("to").alias("b")))
    told = classes.join(counts, "id", "left").join(of, F.col("id") == F.col("node"), "left")
    told = settled(told.select("h", "v", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = good.join(told, ["h", "v"]).select("key", "n_links", "component_id")
    out = out.unionByName(rows.where("not ok").select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
