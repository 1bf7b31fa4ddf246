"""Hard-negative mining over product-quantised vectors, with bounds that lose no candidate and exact reranking.

Vectors become whole numbers floor(SCALE * c). A codebook for each stretch of SUB components is fitted by k-means on a
bounded sample; its centroids are whole numbers, too, so that sums of table look-ups are exact. Every row is encoded:
its codes, and for each stretch the norm of what its centroid leaves, rounded up. An anchor's inner product with a row
then lies within the looked-up score plus or minus the sum of norms of the anchor's stretches times the row's. Rows
stand in chunks that hold codes and norms beside the vectors; a vector is only touched where the bounds can't decide.

Anchors go in groups of about ANCHORS to all tasks, and each task walks through its chunks with the best so far:

1. Positives: the best rows of the anchor's own label. A row is a candidate if its upper bound reaches the worst of
   the best so far; candidates are scored exactly.
2. Negatives: for each positive a window of scores, in whole numbers. A candidate of another label may lie in the
   window, and its upper bound reaches the worst of the window's best so far; candidates are scored exactly.

What tasks found is merged by anchor and window: at most as many rows from each task as are wanted in all.

Edge cases: rows with a null id, label or vector, with null or non-finite components, or an empty vector take no part;
only vectors of equal length meet, so an anchor may have no positives;
of rows that share an id one takes part, that with the least label, then the least vector; components beyond what keeps
scores within 55 bits count as the largest that does; a zero vector scores 0 with all; ties in score go to the smaller
id; an anchor without positives, or a positive without negatives, gives no rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.llm.shared import finite, settled

SCALE, POSITIVES, NEGATIVES, ASKED = 256, 5, 10, 100
#: Components of a code, centroids of a codebook, rounds of k-means, and rows and bytes of vectors that it is fitted on.
SUB, CENTROIDS, ROUNDS, SAMPLE, SAMPLE_BYTES = 2, 256, 8, 20_000, 32 << 20
#: Rows of a chunk, anchors sent together, and anchors looked at together in a task.
CHUNK, ANCHORS, BLOCK = 4096, 4096, 64


@dataclass(frozen=True)
class Codebooks:
    """centroids: stretches x centroids x SUB, whole numbers in doubles; vectors are filled up with zeros to whole stretches."""

    centroids: np.ndarray

    def split(self, v: np.ndarray) -> np.ndarray:
        """Rows x stretches x SUB, as doubles."""
        m, _, sub = self.centroids.shape
        full = np.zeros((len(v), m * sub))
        full[:, : v.shape[1]] = v
        return full.reshape(len(v), m, sub)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes uint8, norms float32 rounded up), both rows x stretches."""
        parts = self.split(v)
        codes, norms = np.empty(parts.shape[:2], np.uint8), np.empty(parts.shape[:2], np.float32)
        for m, book in enumerate(self.centroids):
            part = parts[:, m]
            codes[:, m] = nearest(part, book)
            left = np.sqrt(((part - book[codes[:, m]]) ** 2).sum(axis=1)) * (1 + 1e-6)
            norms[:, m] = np.where(left > 0, np.nextafter(left.astype(np.float32), np.float32(np.inf)), 0)
        return codes, norms


def nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, or one as near but for rounding: any would do for the bounds."""
    return ((book**2).sum(axis=1) - 2 * part @ book.T).argmin(axis=1)


def codebooks(sample: np.ndarray, sub: int = SUB, centroids: int = CENTROIDS, seed: int = 7) -> Codebooks:
    """K-means of each stretch of ``sub`` components, from random rows of the sample."""
    rng = np.random.default_rng(seed)
    parts = Codebooks(np.zeros((-(-sample.shape[1] // sub), 1, sub))).split(sample)
    books = np.zeros((parts.shape[1], centroids, sub))
    for m in range(parts.shape[1]):
        part = parts[:, m]
        distinct = np.unique(part, axis=0)
        book = distinct[rng.permutation(len(distinct))[:centroids]]
        for _ in range(ROUNDS if len(distinct) > centroids else 0):
            code = nearest(part, book)
            n = np.bincount(code, minlength=len(book))
            mean = np.stack([np.bincount(code, part[:, k], minlength=len(book)) for k in range(sub)], axis=1) / np.maximum(n, 1)[:, None]
            book = np.where(n[:, None] > 0, mean, book)
        books[m, : len(book)] = np.rint(book)
        books[m, len(book) :] = books[m, 0]
    return Codebooks(books)


def best(group: np.ndarray, score: np.ndarray, who: np.ndarray, *more: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of rows the first k of each group by falling score, then id, in that order."""
    order = np.lexsort((who, -score, group))
    group = group[order]
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
    order = order[rank < k]
    return (group[rank < k], *(x[order] for x in (score, who, *more)))


@dataclass(frozen=True)
class Asked:
    """A group of anchors, sent to every task: at most a few MB. windows: anchors x positives of (low, high), low > high where there is none."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    books: Codebooks
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def bounds(self, block: slice, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(looked-up scores, how far they may be from the exact ones) of a block of anchors with a chunk's rows."""
        parts = self.books.split(self.vectors[block])
        score = np.zeros((len(parts), len(codes)))
        for m, book in enumerate(self.books.centroids):
            score += np.take(parts[:, m] @ book.T, codes[:, m], axis=1)
        reach = np.sqrt((parts**2).sum(axis=2)) @ norms.T.astype(np.float64)
        return score, reach * (1 + 1e-9)


class Best:
    """The best rows so far of each group, with the score that a row must reach to count."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, -np.inf)
        self.rows: dict[int, tuple] = {}

    def add(self, first: int, groups: int, group: np.ndarray, score: np.ndarray, who: np.ndarray) -> None:
        """Rows of the groups from ``first`` on, as many as ``groups``."""
        if not len(group):
            return
        old = self.rows.get(first)
        rows = best(*(np.concatenate(x) for x in zip(old, (group, score, who), strict=True)) if old else (group, score, who), k=self.k)
        self.rows[first] = rows
        full = np.bincount(rows[0] - first, minlength=groups) == self.k
        last = np.full(groups, -np.inf)
        last[rows[0] - first] = rows[1]  # the last of each group is its least score
        self.least[first : first + groups] = np.where(full, last, -np.inf)

    def all(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return tuple(np.empty(0, dtype=np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*self.rows.values(), strict=True))


def opened(batches):
    """(ids, labels, codes, norms, vectors) of chunks."""
    for batch in batches:
        for size, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield [np.frombuffer(c, t).reshape(size, -1) for c, t in zip(columns, ("<i8", "<i8", "u1", "<f4", "<i8"), strict=True)]


def exact(asked: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole-number inner products of pairs of rows."""
    out = np.empty(len(i), dtype=np.int64)
    for at in range(0, len(i), 1 << 14):
        s = slice(at, at + (1 << 14))
        out[s] = np.einsum("ij,ij->i", asked[i[s]], vectors[j[s]])
    return out


def top_least(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; -inf of shorter ones."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def positives(asked: Asked, batches, k: int) -> tuple[np.ndarray, ...]:
    """(anchor's place, score, id) of the k best rows with the anchor's label in these chunks."""
    found = Best(len(asked.ids), k)
    for ids, labels, codes, norms, vectors in opened(batches):
        for at in range(0, len(asked.ids), BLOCK):
            block = slice(at, at + BLOCK)
            score, reach = asked.bounds(block, codes, norms)
            own = (labels.T == asked.labels[block, None]) & (ids.T != asked.ids[block, None])
            low = np.where(own, score - reach, -np.inf)
            least = np.maximum(found.least[block], top_least(low, k))
            i, j = np.nonzero(own & (score + reach >= least[:, None]))
            found.add(at, len(score), at + i, exact(asked.vectors[block], vectors, i, j), ids[j, 0])
    return found.all()


def negatives(asked: Asked, batches, k: int) -> tuple[np.ndarray, ...]:
    """(window's place, score, id) of the k best rows with another label in each window of each anchor."""
    wide = asked.low.shape[1]
    found = Best(len(asked.ids) * wide, k)
    for ids, labels, codes, norms, vectors in opened(batches):
        for at in range(0, len(asked.ids), BLOCK):
            block = slice(at, at + BLOCK)
            score, reach = asked.bounds(block, codes, norms)
            other = labels.T != asked.labels[block, None]
            upper, lower = np.where(other, score + reach, -np.inf), score - reach
            groups, scores, who = [], [], []
            for w in range(wide):
                low, high = asked.low[block, w, None], asked.high[block, w, None]
                surely = np.where(upper <= high, lower, -np.inf) if len(ids) >= k else lower
                least = np.maximum(np.maximum(found.least[at * wide + w : (at + len(score)) * wide : wide], top_least(np.where(other, surely, -np.inf), k)), low[:, 0])
                i, j = np.nonzero((upper >= least[:, None]) & (lower <= high) & other)
                exactly = exact(asked.vectors[block], vectors, i, j)
                keep = (exactly >= low[i, 0]) & (exactly <= high[i, 0])
                groups.append((at + i[keep]) * wide + w)
                scores.append(exactly[keep])
                who.append(ids[j[keep], 0])
            found.add(at * wide, len(score) * wide, *(np.concatenate(x) for x in (groups, scores, who)))
    return found.all()


def merged(rows: DataFrame, k: int) -> DataFrame:
    """Of what the tasks found (place, score, id) the first k of each place, with their rank."""
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def packed(df: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (id, label, v) as chunks (size, ids, labels, codes, norms, vectors)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                v = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
                codes, norms = books.encode(v)
                columns = [x.tobytes() for x in (part.column(0).to_numpy(), part.column(1).to_numpy(), codes, norms, v)]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], ["size", "ids", "labels", "codes", "norms", "vectors"])

    return df.select("id", "label", "v").mapInArrow(run, "size int, ids binary, labels binary, codes binary, norms binary, vectors binary")


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v array<bigint>), each id once."""
    size = F.size(vector)
    most = F.sqrt(F.lit(float(1 << 55)) / size)
    whole = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, -most), most))
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & finite(vector) & (size > 0))
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.transform(vector, whole).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def mine(rows: DataFrame, dim: int, asked: int, n_positives: int, n_negatives: int, low: tuple[int, int], high: tuple[int, int], sub: int) -> list[DataFrame]:
    """Results for the anchors of rows (id, label, v) of one length, a group of them after another."""
    spark = rows.sparkSession
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("v").toPandas()["v"]  # SAMPLE_BYTES at most
    books = codebooks(np.array([np.asarray(v, dtype=np.float64) for v in sample]), sub)
    chunks = settled(packed(rows, books))
    anchors = settled(rows.where(F.pmod("id", F.lit(asked)) == 0))
    n = anchors.count()
    groups = max(1, -(-n // ANCHORS), -(-n * dim // (ANCHORS * 256)))  # fewer of long vectors go together
    found = []
    for g in range(groups):
        own = anchors.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).orderBy("id").toPandas()  # about ANCHORS rows
        if not len(own):
            continue
        some = Asked(own["id"].to_numpy(), own["label"].to_numpy(), np.array([np.asarray(v, dtype=np.int64) for v in own["v"]]), books)

        def run(step, to, k):
            sent = spark.sparkContext.broadcast(to)

            def task(batches):
                place, score, who = step(sent.value, batches, k)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(score, pa.int64()), pa.array(who, pa.int64())], ["place", "score", "id"])

            out = settled(merged(chunks.mapInArrow(task, "place bigint, score bigint, id bigint"), k))
            sent.unpersist()
            return out

        near = run(positives, some, n_positives).toPandas()  # POSITIVES rows for each anchor of the group
        place, rank = near["place"].to_numpy(), near["rank"].to_numpy() - 1
        score, who = (np.zeros((len(own), n_positives), dtype=np.int64) for _ in range(2))
        at_low, at_high = np.ones_like(score), np.zeros_like(score)
        score[place, rank], who[place, rank] = near["score"].to_numpy(), near["id"].to_numpy()
        at_low[place, rank], at_high[place, rank] = -((-low[0] * score[place, rank]) // low[1]), high[0] * score[place, rank] // high[1]
        to = Asked(some.ids, some.labels, some.vectors, books, at_low, at_high)
        windows = spark.createDataFrame([(int(p) * n_positives + int(r), int(some.ids[p]), int(who[p, r]), int(score[p, r])) for p, r in zip(place, rank, strict=True)], "place bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        hits = run(negatives, to, n_negatives)
        found.append(hits.join(F.broadcast(windows), "place").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return found


def hard_negatives(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", asked: int = ASKED, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), sub: int = SUB) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id ``asked`` divides.

    low, high: a negative's score lies from low[0] / low[1] to high[0] / high[1] of the positive's, both included.
    """
    rows = settled(usable(df, key, vector, label))
    out = None
    for dim in sorted(r[0] for r in rows.select(F.size("v")).distinct().collect()):
        for one in mine(rows.where(F.size("v") == dim), dim, asked, n_positives, n_negatives, low, high, sub):
            out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


ORACLE = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
