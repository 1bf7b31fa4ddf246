"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Documents become ids once. Whole multiples of the sequence length fill sequences of their own; what remains of a
document, under one sequence long, counts in a histogram with one bin for each length. On the driver the bins are
placed longest first, each into the packs that are the shortest so far, as counts of packing patterns: the work there
depends on the sequence length, not on the number of documents. Ranges of ranks within a length then say which
pattern, copy and place each remainder gets; a remainder's rank comes from counts of salted parts of its length, so a
length that a third of all documents share is still spread.

Edge cases: a null text is empty and has the end id alone; every row is packed, repeated rows and null ids included;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
import sys
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.llm.shared import settled

LENGTH, END = 1024, 0
#: Rows in a part of a length within which rows are numbered one after another.
SALTED = 100_000
#: Distinct words whose ids a worker process keeps in memory.
MEMO = 1_000_000
#: A space with white space on both sides joins its neighbours into one token, so such texts aren't cut at spaces.
_RUN = re.compile(r"\s \s")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Known(dict):
    """Space-led words (given without the space) -> ids as bytes; what is new is encoded on the way."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.encode(" " + word)
        return found


class Encoder:
    """Text -> its ids as little-endian 32-bit values, those that the tokenizer file gives.

    The vocabulary's splitting rule always cuts before a space that follows and precedes a word, so a text's ids are
    those of its space-led words one after another; words that were seen before are looked up. New words go through
    the same byte pairs in ``tiktoken``, if the file's merges are its ids in order; special tokens, and texts with
    white space around a space, through ``tokenizers`` as whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        pairs = byte_pairs(spec)
        encode = (lambda t: self.whole([t])[0]) if pairs is None else (lambda t, f=pairs.encode_ordinary: array("I", f(t)).tobytes())
        self.first, self.known = encode, _Known(encode)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMO:
            self.known.clear()
        get, out = self.known.__getitem__, []
        for t in texts:
            if _RUN.search(t) or any(x in t for x in self.special):
                out += self.whole([t])
                continue
            first, *rest = t.split(" ")
            out.append((self.first(first) if first else b"") + b"".join(map(get, rest)))
        return out


def byte_pairs(spec: dict):
    """The tokenizer file's byte pairs as a tiktoken encoding; None if its merges or settings are of another kind."""
    import public_tokenizers
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    model, splits = spec["model"], spec.get("pre_tokenizer") or {}
    ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if all(c in byte for c in token)}
    in_order = all(model["vocab"].get("".join(m)) == 256 + n for n, m in enumerate(model["merges"]))
    plain = sys.byteorder == "little" and model["type"] == "BPE" and splits.get("type") == "ByteLevel" and not splits.get("add_prefix_space") and not spec.get("normalizer")
    if not (plain and in_order and len(ranks) == len(model["merges"]) + 256):
        return None
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it knows serves all of its tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, path: str | None = None) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut into whole sequences and a remainder."""
    path = path or tokenizer_path()
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, out = part.column(0).to_pylist(), [[] for _ in range(5)]
                for k, data in zip(ids, encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    data += last
                    n = len(data) // 4
                    for start in range(0, n, length):
                        piece = data[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (k, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [key, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(key, text).mapInArrow(run, f"{key} bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def patterns(histogram: dict[int, int], size: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: [(lengths in a pack, number of such packs)] that place every length of the histogram.

    Open packs are kept by the room that they have left. A bin takes the packs with the most room, as many of each
    pattern as there are or as it needs; what fits nowhere opens packs.
    """
    room: dict[int, list[list]] = defaultdict(list)
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            most = max((r for r, packs in room.items() if packs and r >= n), default=0)
            if not most:
                room[size - n].append([(n,), left])
                break
            pattern, count = room[most].pop()
            used = min(count, left)
            if used < count:
                room[most].append([pattern, count - used])
            merged = next((x for x in room[most - n] if x[0] == (*pattern, n)), None)
            if merged:
                merged[1] += used
            else:
                room[most - n].append([(*pattern, n), used])
            left -= used
    return [(tuple(p), c) for packs in room.values() for p, c in packs]


def places(found: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, offset) of each run of ranks; a run's ranks go to sequences one after another."""
    runs, taken, base = defaultdict(list), defaultdict(int), 0
    for pattern, count in found:
        at = 0
        for n in pattern:
            runs[n].append((taken[n], base, at))
            taken[n] += count
            at += n
        base += count
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for n, rows in runs.items()}


def ranked(rows: DataFrame, by: str, order: list[str], per: int = SALTED) -> DataFrame:
    """Add ``rank``: 0, 1, 2 ... within each value of ``by``, in no order of meaning, but fixed. rows must be settled."""
    salts = max(1, math.ceil(rows.count() / per)) * 4
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(by, "salt").agg(F.count("*").alias("n"))
    before = counts.select(by, "salt", (F.sum("n").over(Window.partitionBy(by).orderBy("salt")) - F.col("n")).alias("before"))
    numbered = salted.withColumn("own", F.row_number().over(Window.partitionBy(by, "salt").orderBy(*order)))
    return numbered.join(before, [by, "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")


def pack(cut: DataFrame, key: str = "doc_id", size: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to pieces. Whole sequences are numbered after those of the patterns."""
    cut = settled(cut)
    histogram = {r["length"]: r["n"] for r in cut.where(F.col("length") < size).groupBy("length").agg(F.count("*").alias("n")).collect()}  # size - 1 rows at most
    found = patterns(histogram, size)
    where, used = places(found), sum(c for _, c in found)
    cols = ["start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros_like(n), np.zeros_like(n)
            for length in np.unique(n):
                mine = n == length
                if length == size:
                    sequence[mine] = used + rank[mine]
                    continue
                first, base, at = where[int(length)]
                run_ = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = base[run_] + rank[mine] - first[run_], at[run_]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], [key, *cols, "sequence_id", "offset"])

    return ranked(cut, "length", [key, *cols]).select(key, *cols, F.col("rank").cast("bigint")).mapInArrow(run, f"{key} bigint, {', '.join(c + ' bigint' for c in cols)}, sequence_id bigint, offset bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
