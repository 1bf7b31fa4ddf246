"""Substring dedup: fixed-block anchors, rolling probes, extension to exact repeats.

Every window of WINDOW words holds a whole block of BLOCK words out of those that begin at each multiple of BLOCK in
its document, if 2 * BLOCK - 1 <= WINDOW. So the index is the blocks, an anchor is a block that another document has
at any place, and only windows around anchors can be repeats. Two rounds:

1. Anchors. Each document gives the hashes of its rolling stretches of BLOCK words, each once, with a mark on those
   that are blocks. Where a stretch has the least document with it as a block, every later document that has it holds
   an anchor there, as does each document that has it as a block and is followed by another one with it.
2. Repeats. Anchors are extended to both sides: documents give the hashes of every window around theirs. A window that
   also begins in a document with a smaller id is a repeat; where the next one on either side is one as well, the
   repeat goes on, and so the windows in a row form a maximal one. Its words go.

A round deals hashes by bucket, packed in arrays, and gets back to each document those that count. Before, each task
settles what it can from its own documents: of a stretch with many of them only the ends have to be asked about, so
that one line in a third of all documents is no hot key. There are as many buckets as the text's bytes ask for, so a
bucket doesn't grow with the input, and it is settled a slice of its hashes at a time. The first round only narrows down
what to look at, and its hashes may collide (32 bits within a bucket); windows of two documents are equal if two hashes
agree, of 64 and 32 bits and made of different hashes of their words. Answers name windows of one document by the first.

Edge cases: a null text has no words; repeated rows, and rows with one id, don't repeat each other, as their ids are
not smaller; rows with a null id stay whole; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, BLOCK = 13, 7
#: Bytes of text that a bucket's hashes come from on average; slices in which it is settled; the most buckets there can be.
BUCKET_BYTES, SLICES, MOST_BUCKETS = 32 << 20, 8, (1 << 18) - 1
#: Documents that a task looks at together, and distinct words whose hashes it keeps.
TOGETHER, MEMO = 4096, 1_000_000
#: Bytes of text after which a group of documents ends even with fewer of them.
TOGETHER_BYTES = 12 << 20
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """word -> its hash of 64 bits."""

    def __init__(self, digest=xxhash.xxh64_intdigest):
        self.digest = digest

    def __missing__(self, word: bytes) -> int:
        self[word] = value = self.digest(word, 9)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row, from the words' hashes: a polynomial modulo 2**64, its bits spread."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = total * _ODD + words[k : len(words) - n + 1 + k]
    return mix(total)


def second(words: np.ndarray, n: int) -> np.ndarray:
    """Another hash, of other hashes of the words by another factor: 32 bits."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint32)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = (total ^ words[k : len(words) - n + 1 + k]) * _OTHER
        total ^= total >> np.uint64(32)
    return total.astype(np.uint32)


def bucket_count(texts: DataFrame, text: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for the hashes of all texts, at least the session's shuffle partitions."""
    size = texts.agg(F.sum(F.octet_length(text))).collect()[0][0] or 0
    return min(MOST_BUCKETS, max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes)))


def groups(batches):
    """Rows of Arrow batches as lists of columns, TOGETHER rows or TOGETHER_BYTES at a time; the second column is the text."""
    held, size = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            columns = [c.cast(pa.binary()).to_pylist() if pa.types.is_string(c.type) else c.to_pylist() for c in part.columns]
            held = columns if held is None else [a + b for a, b in zip(held, columns, strict=True)]
            size += sum(len(t or b"") for t in columns[1])
            if len(held[0]) + 256 > TOGETHER or size >= TOGETHER_BYTES:
                yield held
                held, size = None, 0
    if held:
        yield held


def begins(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.empty(0, dtype=np.int64)


def changes(value: np.ndarray, check: np.ndarray | None) -> np.ndarray:
    """Where runs of equal hashes begin."""
    if check is None or not len(value):
        return begins(value)
    return np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (check[1:] != check[:-1])))


def standing(value: np.ndarray, check: np.ndarray | None, doc: np.ndarray, block: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of (value, check, doc), each once: masks of those that count already, and of those to ask other tasks about.

    One counts that comes after the least document with the hash as a block; with ``both`` also a block before the
    last document. The two documents that decide this for other tasks' rows are asked about in any case.
    """
    at = changes(value, check)
    if not len(at):
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    size = np.diff(np.append(at, len(value)))
    most = np.iinfo(np.int64).max
    least = np.repeat(np.minimum.reduceat(np.where(block, doc, most), at), size)
    known = doc > least
    ask = ~known
    if both:
        last = np.repeat(np.maximum.reduceat(doc, at), size)
        known |= block & (doc < last)
        ask = ~known | (doc == least) | (doc == last)
    return known, ask


def steps(ids: np.ndarray) -> bytes:
    """Rising ids as steps from one to the next, whose upper bytes are mostly 0 and take no room in a shuffle."""
    return np.diff(ids.astype("<i8"), prepend=0).tobytes()


def of_steps(ids: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.cumsum(np.frombuffer(ids, "<i8")), np.frombuffer(counts, "<u4"))


def packed(docs: np.ndarray, bucket: int, value: np.ndarray, check: np.ndarray | None, block: np.ndarray) -> tuple:
    """A question's row from rows in order of document. Hashes are 4 bytes, or 12 with their check."""
    at = begins(docs)
    hashes = value.astype("<u4").tobytes() if check is None else value.astype("<u8").tobytes() + check.astype("<u4").tobytes()
    return bucket, steps(docs[at]), np.diff(np.append(at, len(docs))).astype("<u4").tobytes(), hashes, np.packbits(block).tobytes()


def hashes_of(hashes: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray | None]:
    if not wide:
        return np.frombuffer(hashes, "<u4"), None
    n = len(hashes) // 12
    return np.frombuffer(hashes, "<u8", n), np.frombuffer(hashes, "<u4", n, 8 * n)


QUESTIONS = "bucket bigint, docs binary, counts binary, hashes binary, flags binary"


def picked(x: np.ndarray | None, by: np.ndarray) -> np.ndarray | None:
    return None if x is None else x[by]


def asking(doc: np.ndarray, value: np.ndarray, check: np.ndarray | None, block: np.ndarray, known: np.ndarray, ask: np.ndarray, bucket: np.ndarray):
    """Arrow rows: one for each bucket that is asked, and one (bucket < 0) with what counts already."""
    rows = []
    if known.any():
        order = np.flatnonzero(known)[np.argsort(doc[known], kind="stable")]
        rows.append(packed(doc[order], -1 - int(doc[0]) % 997, value[order], picked(check, order), block[order]))
    order = np.flatnonzero(ask)
    order = order[np.lexsort((doc[order], bucket[order]))]
    doc, value, check, block, bucket = doc[order], value[order], picked(check, order), block[order], bucket[order]
    at = begins(bucket)
    for lo, hi in zip(at.tolist(), np.append(at, len(bucket))[1:].tolist(), strict=True):
        rows.append(packed(doc[lo:hi], int(bucket[lo]), value[lo:hi], picked(check, slice(lo, hi)), block[lo:hi]))
    if rows:
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "docs", "counts", "hashes", "flags"])


def opened(docs: bytes, counts: bytes, hashes: bytes, flags: bytes, wide: bool):
    value, check = hashes_of(hashes, wide)
    return of_steps(docs, counts), value, check, np.unpackbits(np.frombuffer(flags, np.uint8), count=len(value)).astype(bool)


def answers(rows: DataFrame, buckets: int, wide: bool, both: bool) -> DataFrame:
    """(of, hashes): for each document that has some, its hashes that count.

    Buckets answer with one row for each shard of documents; a shard's rows then become one row for each document.
    """

    kind = "<u8" if wide else "<u4"

    def tell(doc, value):
        shard = (mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, shard))
        doc, value, shard = doc[order], value[order].astype(kind), shard[order]
        at = begins(shard)
        rows = []
        for a, b in zip(at.tolist(), np.append(at[1:], len(doc)).tolist(), strict=True):
            own = a + begins(doc[a:b])
            rows.append((int(shard[a]), steps(doc[own]), np.diff(np.append(own, b)).astype("<u4").tobytes(), value[a:b].tobytes()))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "docs", "counts", "hashes"])

    def settle(parts):
        """A slice of the bucket's hashes at a time, so that what is sorted is small beside the bucket."""
        docs, values = [], []
        for k in range(SLICES):
            some = []
            for part in parts:
                doc, value, check, block = opened(*part, wide)
                mine = value >> value.dtype.type(8 * value.dtype.itemsize - 3) == k
                some.append((doc[mine], value[mine], picked(check, mine), block[mine]))
            doc, value, block = (np.concatenate([x[i] for x in some]) for i in (0, 1, 3))
            check = np.concatenate([x[2] for x in some]) if wide else None
            order = np.lexsort((doc, check, value)) if wide else np.argsort(value.astype(np.uint64) << np.uint64(32) | np.unique(doc, return_inverse=True)[1].astype(np.uint64))
            doc, value, check, block = doc[order], value[order], picked(check, order), block[order]
            known, _ = standing(value, check, doc, block, both)
            docs.append(doc[known])
            values.append(value[known])
        if any(map(len, docs)):
            yield from tell(np.concatenate(docs), np.concatenate(values))

    def run(batches):
        for bucket, parts in runs(batches):
            if bucket < 0:
                for part in parts:
                    yield from tell(*opened(*part, wide)[:2])
            else:
                yield from settle(parts)

    def merge(batches):
        for _, parts in runs(batches):
            doc, value = (np.concatenate(x) for x in zip(*((of_steps(d, n), np.frombuffer(h, kind)) for d, n, h in parts), strict=True))
            order = np.argsort(doc, kind="stable")
            doc, value = doc[order], value[order]
            at = begins(doc)
            ends = np.append(at[1:], len(doc))
            for k in range(0, len(at), 1024):
                some = zip(at[k : k + 1024].tolist(), ends[k : k + 1024].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc[at[k : k + 1024]], pa.int64()), pa.array([value[a:b].tobytes() for a, b in some], pa.binary())], ["of", "hashes"])

    told = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "shard bigint, docs binary, counts binary, hashes binary")
    return told.repartition(buckets, "shard").sortWithinPartitions("shard").mapInArrow(merge, "of bigint, hashes binary")


def runs(batches):
    """(first column's value, [rest of the row]) of rows in order of that value."""
    now, held = None, []
    for batch in batches:
        for value, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and value != now:
                yield now, held
                held = []
            now = value
            held.append(row)
    if held:
        yield now, held


def words_of(memo: _Words, text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    found = (text or b"").split()
    return found, hashed(memo, found)


def hashed(memo: _Words, words: list[bytes]) -> np.ndarray:
    if len(memo) > MEMO:
        memo.clear()
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def anchors(docs: DataFrame, key: str, text: str, buckets: int, block: int = BLOCK) -> DataFrame:
    """(of, hashes): for documents that hold anchors, their stretches' hashes (low 32 bits)."""
    who, hash_, flag = np.uint64(13), np.uint64(32), np.uint64(1)

    def run(batches):
        memo = _Words()
        for ids, texts in groups(batches):
            own, rank = np.unique(np.array(ids, dtype=np.int64), return_inverse=True)
            keys = []
            for k, t in zip(rank.tolist(), texts, strict=True):
                value = rolling(words_of(memo, t)[1], block)
                to = mix(value ^ _ODD) % np.uint64(buckets)
                keys.append(((to << hash_ | value & np.uint64(0xFFFFFFFF)) << who | np.uint64(k)) << flag | (np.arange(len(value)) % block == 0))
            # bucket, hash, document, is a block: one number each; of a hash that a document has twice the block stays
            all_ = np.sort(np.concatenate(keys))
            all_ = all_[np.append(all_[1:] >> flag != all_[:-1] >> flag, True)] if len(all_) else all_
            value, doc, is_block = all_ >> (who + flag), own[(all_ >> flag & np.uint64((1 << 13) - 1)).astype(np.int64)], (all_ & flag).astype(bool)
            known, ask = standing(value, None, doc, is_block, both=True)
            yield from asking(doc, value & np.uint64(0xFFFFFFFF), None, is_block, known, ask, (value >> hash_).astype(np.int64))

    return answers(docs.select(key, text).mapInArrow(run, QUESTIONS), buckets, wide=False, both=True)


def repeats(docs: DataFrame, found: DataFrame, key: str, text: str, buckets: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(of, hashes): for documents with words to go, the hashes of the windows that repeat an earlier document's."""

    def run(batches):
        memo, other = _Words(), _Words(xxhash.xxh3_64_intdigest)
        for ids, texts, hashes in groups(batches):
            docs_, values, checks = [], [], []
            for k, t, h in zip(ids, texts, hashes, strict=True):
                found, words = words_of(memo, t)
                marks = np.isin((rolling(words, block) & np.uint64(0xFFFFFFFF)).astype("<u4"), np.frombuffer(h, "<u4"))
                windows, seen = rolling(words, window), np.append(0, np.cumsum(marks))
                some = seen[window - block + 1 :][: len(windows)] > seen[: len(windows)]  # windows that hold an anchor
                docs_.append(np.full(int(some.sum()), k, dtype=np.int64))
                values.append(windows[some])
                checks.append(second(hashed(other, found), window)[some] if some.any() else np.empty(0, dtype=np.uint32))
            doc, value, check = (np.concatenate(x) for x in (docs_, values, checks))
            order = np.lexsort((doc, check, value))
            doc, value, check = doc[order], value[order], check[order]
            one = np.append(True, (value[1:] != value[:-1]) | (check[1:] != check[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, dtype=bool)
            doc, value, check = doc[one], value[one], check[one]
            every = np.ones(len(doc), dtype=bool)
            known, ask = standing(value, check, doc, every, both=False)
            yield from asking(doc, value, check, every, known, ask, (mix(value ^ _ODD) % np.uint64(buckets)).astype(np.int64))

    met = docs.join(found, F.col(key) == F.col("of")).select(key, text, "hashes")
    return answers(met.mapInArrow(run, QUESTIONS), buckets, wide=True, both=False)


def repeated_runs(words: np.ndarray, hashes: bytes, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal repeats as (first word, past the last), from the words' hashes and those of the windows that repeat."""
    starts = np.flatnonzero(np.isin(rolling(words, window), np.frombuffer(hashes, "<u8")))
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1  # windows that overlap or touch are one repeat
    return [(int(part[0]), int(part[-1]) + window) for part in np.split(starts, cut)]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, n_words, n_removed, kept, repeats): kept is the text's remaining words, joined by one space; repeats are the
    maximal stretches that went, as (start, end) in words, ends exclusive."""
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block")
    here = docs.select(key, text).where(F.col(key).isNotNull())
    buckets = bucket_count(here, text, bucket_bytes)
    found = repeats(here, anchors(here, key, text, buckets, block), key, text, buckets, window, block)
    # The same shuffle of the texts serves both joins.
    whole = here.join(found, F.col(key) == F.col("of"), "left").select(key, text, "hashes")
    whole = whole.unionByName(docs.select(key, text, F.lit(None).cast("binary").alias("hashes")).where(F.col(key).isNull()))

    def run(batches):
        memo = _Words()
        for ids, texts, hashes in groups(batches):
            out = []
            for k, t, h in zip(ids, texts, hashes, strict=True):
                gone = []
                if h:
                    words, values = words_of(memo, t)
                    gone = repeated_runs(values, h, window)
                    edges = [0, *(x for run in gone for x in run), len(words)]
                    kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                else:
                    words = kept = (t or b"").split()
                out.append((k, len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"start": a, "end": b} for a, b in gone]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [key, "n_words", "n_removed", "kept", "repeats"])

    return whole.mapInArrow(run, f"{key} bigint, n_words bigint, n_removed bigint, kept string, repeats array<struct<start:bigint,end:bigint>>")


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT coalesce(list_contains(gone, i), false)), lambda i: w[i]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
