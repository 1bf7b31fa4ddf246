"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, each text scanned once.

Texts and items are lower-cased in A-Z and cut into words of digits, a-z and everything beyond ASCII. The automaton's
letters are words, and its patterns the windows of WINDOW words of the items' fields; an item of fewer words is one
window. Every word of a text is a step, every occurrence of every window is reported at its last word, and the words
that occurrences cover are mapped to offsets of the original text.

The automaton is built in each Python worker from pairs (window, item) that are sent to it, PATTERN_BYTES of them at
most. A larger benchmark is dealt out by hash into as many automata as it takes; texts pass each of them in turn, and
what they find is merged by row, so that no task and no driver holds more than one.

Edge cases: a null text, item or field has no words and no window; a null item id is named by the empty string; rows
that share an item id are one item with the windows of both; repeated rows of documents each get a row, ids may be null
or repeat; no benchmark items, or none with words, hit nothing; an empty table gives an empty result; other columns of
both tables are ignored, whatever their names.
"""

from __future__ import annotations

import re
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.shared import settled

WINDOW = 10
#: Bytes of windows and item ids, with PAIR_BYTES for each pair, that one automaton is made of.
PATTERN_BYTES, PAIR_BYTES = 24 << 20, 64

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
#: Bytes of words stay, A-Z become a-z, all else a blank.
_PLAIN = bytes(b if _WORD.fullmatch(bytes([b])) else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def windows(items: DataFrame, key: str, fields: tuple[str, ...], window: int) -> DataFrame:
    """(window binary, item string), each pair once. Words of a window are joined by a blank."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pairs = set()
                for item, *texts in zip(part.column(0).to_pylist(), *(c.cast(pa.binary()).to_pylist() for c in part.columns[1:]), strict=True):
                    for words in map(words_of, texts):
                        pairs |= {(b" ".join(words[i : i + window]), item) for i in range(max(1, len(words) - window + 1)) if words}
                found = sorted(pairs)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([i for _, i in found], pa.string())], ["window", "item"])

    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")), *[F.col(f).cast("string") for f in fields])
    return named.toDF("item", *[f"f{i}" for i in range(len(fields))]).mapInArrow(run, "window binary, item string").distinct()


class Automaton:
    """Finds windows in lists of words. Pickles as the pairs it is made of; each worker builds it once."""

    def __init__(self, pairs: pa.Table):
        self.pairs = pairs
        self.trie = None

    def __getstate__(self):
        return {"pairs": self.pairs, "trie": None}

    def build(self) -> None:
        of: dict[bytes, list[str]] = {}
        for window, item in zip(self.pairs.column(0).to_pylist(), self.pairs.column(1).to_pylist(), strict=True):
            of.setdefault(window, []).append(item)
        self.items = list(of.values())
        self.number: dict[bytes, int] = {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, window in enumerate(of):
            letters = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.split(b" "))
            self.trie.add_word(letters, (len(letters), k))
        self.trie.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(runs of covered words as (first, past the last), items)."""
        if self.trie is None:
            self.build()
        if not self.items:
            return [], set()
        runs, met = [], set()
        for last, (size, k) in self.trie.iter(tuple(map(self.number.get, words, repeat(0)))):
            first, past = last + 1 - size, last + 1
            while runs and runs[-1][1] >= first:  # ends only grow, so what it touches is at the end
                first = min(first, runs.pop()[0])
            runs.append((first, past))
            met.add(k)
        return runs, {item for k in met for item in self.items[k]}


def offsets(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as code points of the text, ends exclusive."""
    at = [m.span() for m in _WORD.finditer(text.translate(_PLAIN).replace(b" ", b"\0"))]
    points = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    return [{"start": int(points[at[a][0]]), "end": int(points[at[b - 1][1]])} for a, b in runs]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scanned(docs: DataFrame, pairs: pa.Table) -> DataFrame:
    """(row, key, n_words, runs, spans, items) of docs (row, key, text) by one automaton."""
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(pairs))  # PATTERN_BYTES at most

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, runs, spans, items = [], [], [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    words = words_of(text)
                    found, met = sent.value.find(words)
                    counts.append(len(words))
                    runs.append([{"start": a, "end": b} for a, b in found])
                    spans.append(offsets(text, found) if found else [])
                    items.append(sorted(met))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(runs, SPANS), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], ["row", "key", "n_words", "runs", "spans", "items"])

    kind = "array<struct<start:bigint,end:bigint>>"
    return docs.mapInArrow(run, f"row bigint, key {docs.schema['key'].dataType.simpleString()}, n_words bigint, runs {kind}, spans {kind}, items array<string>")


def merged(runs: str) -> Column:
    """Runs of several automata, which may overlap, as disjoint ones in order."""
    kind = "array<struct<start:bigint,end:bigint>>"
    step = lambda acc, r: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= r["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], r["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(r)))
    return F.aggregate(F.array_sort(F.flatten(runs)), F.array().cast(kind), step)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", fields: tuple[str, ...] = ("text",), window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """(key, n_words, n_hit, items, spans) for every row of docs.

    items: the ids, as strings in order, of items with a window in the text. spans: (start, end) in code points of the
    original text, from the first to past the last of the words in each unbroken run of hit words.
    """
    pairs = settled(windows(benchmark, item, fields, window))
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item") + PAIR_BYTES), F.lit(0))).collect()[0][0]
    shards = max(1, -(-size // pattern_bytes))
    rows = docs.select(F.lit(0).cast("bigint").alias("row") if shards == 1 else F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    if shards == 1:
        found = scanned(rows, pairs.toArrow())
    else:
        rows = settled(rows)  # so that all automata see the same numbers of rows
        own = F.pmod(F.xxhash64("window", "item"), F.lit(shards))
        found = None
        for k in range(shards):
            one = settled(scanned(rows, pairs.where(own == k).toArrow()))
            found = one if found is None else found.unionByName(one)
        found = found.groupBy("row").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.collect_list("runs").alias("runs"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))  # a row for each automaton
        found = found.withColumns({"runs": merged("runs"), "spans": merged("spans"), "items": F.array_sort(F.array_distinct(F.flatten("items")))})
    hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return found.select(F.col("key").alias(key), "n_words", hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans")


def query(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CUT = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH i AS (SELECT item_id, {_CUT} AS w FROM benchmark), d AS (SELECT doc_id, {_CUT} AS w FROM documents),
p AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
o AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p))),
m AS (SELECT doc_id, k, n, item_id FROM o JOIN p USING (n, g)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
