"""Near copies of the pipeline: every pair of five-word Jaccard 0.8 or more is found, and no other is linked."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracegrid.llm import simhash


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def planted(spark):
    """id -> text, similarities of all pairs that share a shingle, and id -> component_id as found."""
    rng = np.random.default_rng(17)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    base = [t.split() for t in texts.values() if 60 <= len(t.split()) <= 2000]
    new = max(texts) + 1
    for k in range(200):
        w = list(base[int(rng.integers(len(base)))])
        if k % 2:
            for at in rng.integers(0, len(w), 1 + len(w) // int(rng.integers(40, 100))).tolist():
                w[at] = f"edit{rng.integers(1 << 40)}"
        else:
            n = int(len(w) * rng.uniform(0.02, 0.18))
            at = int(rng.integers(0, len(w) - n))
            w[at : at + n] = [f"new{x}" for x in rng.integers(0, 1 << 40, n)]
        texts[new + k] = " ".join(w)
    for k in range(40):  # a large group about one text, some of it too far from some
        w = list(base[0][:300])
        n = int(len(w) * rng.uniform(0.0, 0.2))
        at = int(rng.integers(0, len(w) - n))
        w[at : at + n] = [f"hot{x}" for x in rng.integers(0, 1 << 40, n)]
        texts[new + 1000 + k] = " ".join(w)
    sets = {k: shingles(t) for k, t in texts.items()}
    classes, has = {}, defaultdict(list)
    for k in sorted(sets):
        classes.setdefault(frozenset(sets[k]), k)
    least = {k: classes[frozenset(s)] for k, s in sets.items()}
    for k in set(least.values()):
        for x in sets[k]:
            has[x].append(k)
    shared = Counter((min(a, b), max(a, b)) for ids in has.values() if len(ids) < 400 for i, a in enumerate(ids) for b in ids[i + 1 :])
    like = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    return least, like, found


def test_every_pair_is_found(planted):
    least, like, found = planted
    near = [p for p, s in like.items() if s >= 0.8]
    missed = [p for p in near if found[p[0]] != found[p[1]]]
    print(f"pairs of different sets at 0.8 or more: {len(near)}, missed: {len(missed)}")
    assert len(near) > 100 and not missed
    assert all(found[k] == found[v] for k, v in least.items())


def test_no_other_is_linked(planted):
    least, like, found = planted
    best = defaultdict(float)
    for (a, b), s in like.items():
        best[a], best[b] = max(best[a], s), max(best[b], s)
    alone = [k for k in set(least.values()) if best[k] < 0.8]
    print(f"texts whose best similarity is below 0.8: {len(alone)}, from 0.6 on: {sum(best[k] >= 0.6 for k in alone)}")
    assert sum(best[k] >= 0.6 for k in alone) > 10
    assert all(found[k] == k for k in alone)


def test_bound_of_parities():
    """No pair of sets at 0.8 fails the bound, of any size; of sets that fit the bits, those well below 0.8 do."""
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 400, 1500, 6000, 40000):
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        for _ in range(30):
            drop = int(rng.integers(0, len(base) // 3 + 1))
            other = np.unique(np.append(base[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, drop + 1)), dtype=np.uint64)))
            both = len(np.intersect1d(base, other))
            apart = len(base) + len(other) - 2 * both
            minima = np.zeros((2, simhash.BANDS * simhash.ROWS), np.uint8)
            tail = [np.append(simhash.parity(h), np.frombuffer(len(h).to_bytes(8, "little"), np.uint8)) for h in (base, other)]
            near = simhash.may_be_near(np.hstack([minima, np.array(tail)]))(np.array([0]), np.array([1]))[0][0]
            assert np.bitwise_count(simhash.parity(base) ^ simhash.parity(other)).sum() <= apart
            if 9 * both >= 4 * (len(base) + len(other)):
                assert near
            elif size <= 400 and 9 * apart > 1.3 * (len(base) + len(other)):
                assert not near


def test_candidates_of_a_group_that_is_alike_but_not_near(spark):
    """A group whose pairs are mostly alike by 0.6 to 0.8 gives few pairs to look at exactly, all links among them."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in range(200)]
    texts = {}
    for k in range(300):
        w = list(base)
        for at in rng.choice(200, 3, replace=False):
            w[at] = f"n{rng.integers(1 << 40)}"
        texts[k] = " ".join(w)
    sets = {k: shingles(t) for k, t in texts.items()}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    near = {p for p, s in like.items() if s >= 0.8}
    told = simhash.signatures(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), "doc_id", "text")
    told.createOrReplaceTempView("told")
    members = spark.sql("select bands[0] * 0 as bucket, node, node as root from told")
    name = {r["node"]: r["doc_id"] for r in told.collect()}
    got = {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in simhash.met_pairs(members, told.select("node", "sig"), part=64).collect()}
    assert near <= got
    alike = sum(0.6 <= s < 0.8 for s in like.values())
    print(f"pairs: {len(like)}, at 0.8 or more: {len(near)}, at 0.6 to 0.8: {alike}, looked at: {len(got)}")
    assert alike > 20000 and len(got) < len(near) + 0.3 * alike
    few = [(name[r["a"]], name[r["b"]]) for r in simhash.met_pairs(members, told.select("node", "sig"), spanning=True).collect()]
    assert {tuple(sorted(p)) for p in few} <= got and len(few) < len(texts)
    assert grouped(few) == grouped(got)


def grouped(pairs):
    """What the pairs connect, as a set of sets."""
    of = {}
    for a, b in pairs:
        one = of.setdefault(a, {a}) | of.setdefault(b, {b})
        for k in one:
            of[k] = one
    return {frozenset(s) for s in of.values()}


def test_fingerprints_link_near_copies(spark, monkeypatch):
    """SimHash itself connects a long text and its copy with one other word, without any candidate of a band."""
    monkeypatch.setattr(simhash, "met_pairs", lambda *_, **__: spark.createDataFrame([], "a bigint, b bigint"))
    words = [f"w{k * k % 1009}" for k in range(900)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(reversed(words)))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
