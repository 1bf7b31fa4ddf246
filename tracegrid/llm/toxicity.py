"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Labels are of documents. They become labels of tokens by a small set of marker features (a word, or a beginning of
words) that between them explain the toxic documents and hardly occur in clean ones. The field learns from tokens so
labelled: weights of hashed word features, and transitions between two states. Forward-backward gives each token's
marginal; tokens of 0.5 or more in a row are an offending span, and a logistic curve, fitted on labelled documents that
the field has not seen, turns the marginals' sum into a score.

The field is fitted in one task on at most MOST_TOXIC and MOST_CLEAN labelled documents and FIT_CHARS code points of
text, whole documents in order of their hashed ids. Everything else covers all documents, in tasks that hold the model
and one group of documents at a time.

Edge cases: a null text is empty; a text without words gets the score that the curve gives to no evidence; repeated
rows and null ids get scores as any; of rows that repeat a labelled id the least text is learned from; labels that are
null or neither 0 nor 1, or without a document, count for nothing, and of several for one id the greatest counts;
without labels of both kinds every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.shared import settled

MOST_TOXIC, MOST_CLEAN, FIT_CHARS = 2000, 4000, 32_000_000
#: Buckets of the hashed features; tokens in a training stretch; passes; step; weight of the squared norm.
HASHED, STRETCH, PASSES, STEP, RIDGE = 1 << 18, 64, 60, 0.5, 1e-6
#: Markers that a toxic document is to have before it counts as explained; least documents, and precision, of a marker.
MARKS, MARK_DOCS, MARK_PRECISION = 3, 3, 0.97
#: Documents looked at together; words whose weights a task keeps.
TOGETHER, MEMO = 1024, 500_000
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 letters and its last 3."""
    w = word.lower()
    return ["=" + w, *("^" + w[:n] for n in range(3, 7) if len(w) > n), "$" + w[-3:]]


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % HASHED for f in features(word)]


class Vocabulary(dict):
    """Word -> its number, given at first sight, with each word's features as numbers in one flat array."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def index(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(features, flat, ends): word n has the features flat[ends[n]:ends[n + 1]]."""
        names: dict[str, int] = {}
        flat = [[names.setdefault(f, len(names)) for f in features(w)] for w in self]
        ends = np.cumsum([0, *map(len, flat)])
        return list(names), np.fromiter((f for x in flat for f in x), dtype=np.int32, count=ends[-1]), ends


def spread(flat: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The features of all the given words, one word's after another's."""
    size = ends[words + 1] - ends[words]
    return flat[np.repeat(ends[words] - np.cumsum(size) + size, size) + np.arange(size.sum())]


def markers(texts: list[np.ndarray], toxic: list[bool], names: list[str], flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the features, taken greedily, that the most toxic texts lack explanations for and that few clean ones have.

    texts: the distinct words of each. Endings are no markers.
    """
    good, bad, own = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), {}
    for n, (words, y) in enumerate(zip(texts, toxic, strict=True)):
        found = np.unique(spread(flat, ends, words))
        if y:
            own[n] = found
            bad[found] += 1
        else:
            good[found] += 1
    rate = max(1, sum(toxic)) / max(1, len(toxic) - sum(toxic))
    fit = (bad >= MARK_DOCS) & (bad >= MARK_PRECISION * (bad + rate * good)) & (good <= 0.01 * bad + 0.5) & np.array([f[0] != "$" for f in names], dtype=bool)
    docs: dict[int, list[int]] = {}
    for n, found in own.items():
        for f in found[fit[found]].tolist():
            docs.setdefault(f, []).append(n)
    lacks = dict.fromkeys(own, MARKS)
    gain = {f: len(ns) for f, ns in docs.items()}
    chosen = np.zeros(len(names), dtype=bool)
    while gain:
        f = max(gain, key=lambda k: (gain[k], len(names[k]), names[k]))
        fresh = sum(lacks[n] > 0 for n in docs[f])
        if fresh < gain[f]:  # counts only fall, so a feature that still leads after a recount is the best
            if fresh < MARK_DOCS:
                del gain[f]
            else:
                gain[f] = fresh
            continue
        chosen[f] = True
        for n in docs[f]:
            lacks[n] -= 1
        del gain[f]
    return chosen


def _log_sum(a, b):
    return np.logaddexp(a, b)


def messages(odds: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ahead, behind): log-odds of state 1 at each token from itself and what precedes it, and from what follows it.

    odds: per token, texts one after another; trans[i, j]: score of i -> j. All texts advance together, the longest
    first, so a step works on those that are still going.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    ahead, behind = np.zeros_like(odds), np.zeros_like(odds)
    longest = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(longest), side="left")  # texts longer than t
    for t in range(longest):
        at = start[: going[t]] + t
        if t == 0:
            ahead[at] = odds[at]
        else:
            r = ahead[at - 1]
            ahead[at] = odds[at] + _log_sum(r + trans[1, 1], trans[0, 1]) - _log_sum(r + trans[1, 0], trans[0, 0])
    for t in range(longest - 2, -1, -1):
        at = start[: going[t + 1]] + t
        s = behind[at + 1] + odds[at + 1]
        behind[at] = _log_sum(s + trans[1, 1], trans[1, 0]) - _log_sum(s + trans[0, 1], trans[0, 0])
    return ahead, behind


def forward_backward(odds: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Logit of each token's marginal for state 1."""
    ahead, behind = messages(odds, lengths, trans)
    return ahead + behind


def slopes(odds: np.ndarray, y: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the chains' negative log-likelihood by the tokens' odds and by the transitions.

    A transition's slope is the expected number of times it is taken less the number in y. The marginal of two
    neighbours is proportional to what the first has from before, the transition, and what the second has from itself
    and from behind.
    """
    ahead, behind = messages(odds, lengths, trans)
    wrong = 1 / (1 + np.exp(-(ahead + behind))) - y
    first = np.ones(len(odds), dtype=bool)
    first[np.cumsum(lengths[lengths > 0]) - 1] = False
    first = np.flatnonzero(first)
    r, s = ahead[first], (odds + behind)[first + 1]
    joint = np.stack([np.full(len(r), trans[0, 0]), trans[0, 1] + s, r + trans[1, 0], r + trans[1, 1] + s])
    joint = np.exp(joint - joint.max(axis=0)) if len(r) else joint
    expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
    u, v = y[first], y[first + 1]
    return wrong, expected - np.array([[((1 - u) * (1 - v)).sum(), ((1 - u) * v).sum()], [(u * (1 - v)).sum(), (u * v).sum()]])


class Field:
    """The fitted field and curve; a few arrays of fixed size."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, curve: tuple[float, float]):
        self.weights, self.bias, self.trans, self.curve = weights.astype(np.float32), bias, trans, curve
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def odds(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        new = [w for w in set(words) if w not in memo]
        ids = [slots(w) for w in new]
        flat = self.weights[np.fromiter((i for x in ids for i in x), dtype=np.int64)]
        sums = np.add.reduceat(flat, np.cumsum([0] + [len(x) for x in ids[:-1]])) if new else []
        memo.update(zip(new, (np.asarray(sums, dtype=np.float64) + self.bias).tolist(), strict=True))
        return np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Logits of the tokens' marginals for each text."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        odds = np.concatenate([self.odds(t) for t in texts]) if len(texts) else np.empty(0)
        return np.split(forward_backward(odds, lengths, self.trans), np.cumsum(lengths)[:-1]) if len(texts) else []

    def score(self, logits: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * evidence(logits), -30, 30))))


def evidence(logits: np.ndarray) -> float:
    """Log of the expected number of toxic tokens, bounded below."""
    return float(np.log(1e-4 + np.exp(-np.logaddexp(0, -logits)).sum()))


def fit(texts: list[str], toxic: list[bool]) -> Field | None:
    if len(set(toxic)) < 2:
        return None
    numbers = Vocabulary()
    words = []
    for t in texts:
        found = _WORD.findall(t)
        words.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
    held = [zlib.crc32(t.encode(errors="replace")) % 4 == 0 for t in texts]  # for the curve
    if not all(any(y == z and not h for y, h in zip(toxic, held, strict=True)) for z in (True, False)):
        held = [False] * len(texts)
    known = [n for n, h in enumerate(held) if not h]
    names, flat, ends = numbers.index()
    if not len(flat):
        return None
    marks = markers([np.unique(words[n]) for n in known], [toxic[n] for n in known], names, flat, ends)
    marked = np.logical_or.reduceat(marks[flat], ends[:-1])
    # Tokens of toxic texts with a marker are positive; of the stretches without any, one in four is learned from.
    stretches, labels = [], []
    for n in known:
        own = words[n]
        for at in range(0, len(own), STRETCH):
            part = own[at : at + STRETCH]
            y = marked[part] & toxic[n]
            if y.any() or (at // STRETCH) % 4 == n % 4:
                stretches.append(part)
                labels.append(y)
    if not stretches:
        return None
    slot_of = np.fromiter((zlib.crc32(f.encode()) % HASHED for f in names), dtype=np.int64, count=len(names))[flat]
    word_of = np.repeat(np.arange(len(numbers)), np.diff(ends))
    lengths, token, y = np.array([len(s) for s in stretches]), np.concatenate(stretches), np.concatenate(labels).astype(np.float64)
    weights, bias, trans = np.zeros(HASHED), -4.0, np.array([[0.0, -2.0], [-1.0, 0.0]])
    seen, seen_bias, seen_trans = np.full(HASHED, 1e-8), 1e-8, np.full((2, 2), 1e-8)

    def odds_of() -> np.ndarray:
        return np.bincount(word_of, weights[slot_of], minlength=len(numbers)) + bias

    for _ in range(PASSES):
        wrong, slope_trans = (x / len(stretches) for x in slopes(odds_of()[token], y, lengths, trans))
        slope = np.bincount(slot_of, np.bincount(token, wrong, minlength=len(numbers))[word_of], minlength=HASHED) + RIDGE * weights
        slope_bias = wrong.sum()
        seen, seen_bias, seen_trans = seen + slope**2, seen_bias + slope_bias**2, seen_trans + slope_trans**2
        weights -= STEP * slope / np.sqrt(seen)
        bias -= STEP * slope_bias / np.sqrt(seen_bias)
        trans = trans - 0.1 * slope_trans / np.sqrt(seen_trans)
    check, odds = [n for n, h in enumerate(held) if h] or known, odds_of()
    x = []
    for k in range(0, len(check), TOGETHER):
        some = [words[n] for n in check[k : k + TOGETHER]]
        sizes = np.array([len(w) for w in some], dtype=np.int64)
        x += [evidence(m) for m in np.split(forward_backward(odds[np.concatenate(some)], sizes, trans), np.cumsum(sizes)[:-1])]
    return Field(weights, bias, trans, curve(np.array(x), np.array([toxic[n] for n in check], dtype=np.float64)))


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable, slightly drawn towards zero, by Newton's steps."""
    beta = np.zeros(2)
    z = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        ridge = np.diag([1e-3, 1e-2])
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def held_out(key: Column) -> Column:
    """True for rows from which no label may be learned."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Field | None:
    """Fit on a bounded sample of labelled documents that are not held out."""
    own = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col(key))).groupBy(key).agg(F.max("toxic").alias("toxic"))
    own = own.withColumn("turn", F.xxhash64(key))
    parts = [own.where(F.col("toxic") == y).orderBy("turn", key).limit(n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    some = parts[0].unionByName(parts[1])
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("body")).join(F.broadcast(some), key)  # MOST_TOXIC + MOST_CLEAN rows at most
    rows = settled(rows.groupBy(key, "toxic", "turn").agg(F.min("body").alias("body")))
    chosen, size = [], 0
    for r in rows.select(key, "turn", F.length("body").alias("n")).orderBy("turn", key).collect():
        size += r["n"]
        if size <= FIT_CHARS:
            chosen.append(r[key])
    if size > FIT_CHARS:
        rows = rows.where(F.col(key).isin(chosen))

    def run(batches):
        held = sorted((r[key], r["body"], r["toxic"]) for batch in batches for r in batch.to_pylist())
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit([t for _, t, _ in held], [bool(y) for *_, y in held]))]})

    # One task, as FIT_CHARS code points at most are learned from; the driver gets the model alone.
    return pickle.loads(rows.select(key, "body", "toxic").coalesce(1).mapInArrow(run, "model binary").collect()[0]["model"])


SCORED = "score double, toxic_spans array<struct<start:bigint,end:bigint>>"


def scored(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, toxic_spans) for every row; spans are code points, ends exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = [t or "" for t in part.column(1).to_pylist()]
                if model is None:
                    scores, spans = [0.0] * len(texts), [[] for _ in texts]
                else:
                    marks = model.marginals([_WORD.findall(t) for t in texts])
                    scores = [model.score(m) for m in marks]
                    spans = [offending(t, m) for t, m in zip(texts, marks, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], [key, "score", "toxic_spans"])

    return docs.select(key, text).mapInArrow(run, f"{key} bigint, {SCORED}")


def offending(text: str, logits: np.ndarray) -> list[dict]:
    """Runs of tokens with marginals of 0.5 or more."""
    hit = logits >= 0
    if not hit.any():
        return []
    spans, last = [], None
    for n, m in enumerate(_WORD.finditer(text)):
        if hit[n]:
            if last == n - 1 and spans:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
            last = n
    return spans


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score under ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, key, text))
    at = docs.columns.index(text)

    def run(batches):
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                if model is not None:
                    marks = model.marginals([_WORD.findall(t or "") for t in part.column(at).to_pylist()])
                    part = part.filter(pa.array([model.score(m) < least for m in marks]))
                yield part

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = scored(docs, learn(docs, labels))
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("toxic_spans"))
