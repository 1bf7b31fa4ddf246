"""The ten operators against brute force on small frames, and their defined results in odd cases."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracegrid.llm import components, forest_dedup, mixing, packing, pii, secrets, simhash, sketches, substrings, toxicity, warc

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One two three four five six"), (5, "one TWO three four five six"), (6, "word " * 3000), (6, "word " * 3000), (None, "a null id"), (7, "ünï çødé " * 9 + "mail a.b@ex.org AKIA" + "Z9" * 9)]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark, extra=True):
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("bigint"), "spans": F.lit(1), "component_id": F.lit(2), "fp": F.lit(3), "h": F.lit(4)}) if extra else df


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


def shingles(text, n=4):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def brute_simhash(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups_of(links, nodes):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(-5, 100), (7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for x in links[:-1] for n in x if x != (7, 7)}
    assert found == groups_of(links[:-2], nodes)


def test_simhash_against_brute_force(spark, docs):
    texts = texts_of(docs)
    prints = {k: brute_simhash(t) for k, t in texts.items()}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    least = groups_of(links, ids)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, SF).collect()}
    assert found == {k: (f"{prints[k]:016x}", least[k]) for k in ids}


def test_bit_sliced_parts_find_what_rows_find():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, size=70).astype(np.uint64)
    left, right = base[:40], base[20:] ^ (np.uint64(1) << rng.integers(0, 64, size=50).astype(np.uint64))
    want = {(i, j) for i, a in enumerate(left.tolist()) for j, b in enumerate(right.tolist()) if (a ^ b).bit_count() <= 4}
    got = {(int(i), int(j)) for a, b in simhash.close_parts(left, right, 4) for i, j in zip(a, b, strict=True)}
    assert got == want


def test_simhash_odd_rows(spark):
    rows = simhash.groups(odd(spark)).collect()
    assert len(rows) == len(ODD)
    of = {r["doc_id"]: r["component_id"] for r in rows}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[5] == 4 and of[6] == 6
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 6, 6, 7]
    assert simhash.groups(odd(spark).limit(0)).count() == 0


def test_sketches_against_brute_force(spark, docs):
    texts = texts_of(docs)
    ids = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in sketches.query(spark, SF).collect()}
    assert set(rows) == set(ids)
    for k, doc in enumerate(ids):
        text, after = texts[doc], texts[ids[(k + 1) % len(ids)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert rows[doc]["n_chars"] == len(text) and rows[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    for doc in ids[:60]:
        text, after = texts[doc], texts[ids[(ids.index(doc) + 1) % len(ids)]]
        exact = lambda t: {tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} if words(t) else set()
        a, b = exact(text), exact(after)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(rows[doc]["near_next"] - true) < 0.2
        assert abs(rows[doc]["n_distinct"] - len(a)) <= 0.4 * len(a) + 1


def test_sketches_merge_and_odd_rows(spark):
    both = sketches.with_sketch(odd(spark), "text", "sketch")
    rows = both.collect()
    assert len(rows) == len(ODD) and {tuple(r["sketch"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {()}
    whole = spark.createDataFrame([("a b c d e f g h i j", 1), ("f g h i j k l m n o", 1), ("x y z x y z", 2)], "text string, g int")
    parts = sketches.with_sketch(whole, "text", "s")
    merged = {r["g"]: r["s"] for r in sketches.merge_parts(parts, ["g"], "s").collect()}
    one = [r["s"] for r in parts.where("g = 1").collect()]
    assert merged[1] == sorted(set(one[0]) | set(one[1]))[: sketches.K]


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    rows = [(r["score"], r["predicted"], r["toxic"]) for r in found.where("toxic is not null").collect()]
    right = sum(p == y for _, p, y in rows) / len(rows)
    share = sum(y for *_, y in rows) / len(rows)
    assert right > max(share, 1 - share) and right > 0.95
    for r in found.limit(20).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_query_against_plain_recursion(spark, docs):
    """Every score of the query from the learned field's parameters, by scaled forward and backward products, text by text."""
    from math import exp, log

    field = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    found = {r["doc_id"]: r for r in toxicity.query(spark, SF).collect()}
    step = np.exp(field.trans)
    texts = texts_of(docs)
    assert set(found) == set(texts)
    for k, text in texts.items():
        tokens = toxicity._WORD.findall(text)
        emit = np.array([[1.0, exp(o)] if o < 0 else [exp(-o), 1.0] for o in field.odds(tokens)]).reshape(-1, 2)
        ahead, behind = np.ones((len(emit), 2)), np.ones((len(emit), 2))
        for t in range(len(emit)):
            row = emit[t] * (ahead[t - 1] @ step if t else 1.0)
            ahead[t] = row / row.sum()
        for t in range(len(emit) - 2, -1, -1):
            row = step @ (emit[t + 1] * behind[t + 1])
            behind[t] = row / row.sum()
        both = ahead * behind
        logits = np.array([log(max(b, 1e-300)) - log(max(a, 1e-300)) for a, b in both])
        want = field.score(logits)
        assert found[k]["score"] == pytest.approx(want, abs=1e-6)
        assert found[k]["predicted"] == int(found[k]["score"] >= 0.5) and found[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    odds, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {p: np.exp(sum(odds[k] * s for k, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))) for p in product((0, 1), repeat=5)}
    want = [sum(w for p, w in weight.items() if p[k]) / sum(weight.values()) for k in range(5)]
    got = 1 / (1 + np.exp(-toxicity.forward_backward(odds, np.array([5]), trans)))
    assert np.allclose(got, want)


def test_transition_slopes_against_differences():
    """The gradient of the likelihood of whole chains, each enumerated, by small steps of every odd and transition."""
    from itertools import product

    rng = np.random.default_rng(2)
    lengths = np.array([6, 1, 4, 2])
    odds, trans, y = rng.normal(scale=2, size=13), rng.normal(scale=2, size=(2, 2)), rng.integers(0, 2, 13).astype(float)

    def loss(odds, trans):
        total = 0.0
        for at, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
            score = lambda p, at=at: sum(odds[at + k] * s for k, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))
            total += np.log(sum(np.exp(score(p)) for p in product((0, 1), repeat=int(n)))) - score(tuple(y[at : at + n].astype(int)))
        return total

    by_odds, by_trans = toxicity.slopes(odds, y, lengths, trans)
    step = 1e-6
    for k in range(13):
        e = np.eye(13)[k] * step
        assert by_odds[k] == pytest.approx((loss(odds + e, trans) - loss(odds - e, trans)) / (2 * step), abs=1e-6)
    for i, j in product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[i, j] = step
        assert by_trans[i, j] == pytest.approx((loss(odds, trans + e) - loss(odds, trans - e)) / (2 * step), abs=1e-6)


def test_toxicity_learns_from_bounded_rows(spark, monkeypatch):
    texts = [(k, f"plain words about weather number{k % 7}" + (" grumblefoo nastybar" if k % 2 else "")) for k in range(400)]
    train = spark.createDataFrame(texts + texts[:50] * 3, SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "FIT_CHARS", 4000)
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: sum(map(len, texts)))
    assert 3900 < toxicity.learn(train, labels) <= 4000


def test_toxicity_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.scored(odd(spark), toxicity.learn(odd(spark), none)).collect()} == {0.0}
    assert toxicity.scored(odd(spark).limit(0), None).count() == 0 and toxicity.clean(odd(spark).limit(0), none).columns == odd(spark).columns
    bad = [(k, f"plain words here about weather and trains number{k}" + (" grumblefoo nastybar grumblefoo" if k % 2 else "")) for k in range(80)]
    train = spark.createDataFrame(bad, SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (3, None), (999, 1)], "doc_id bigint, toxic int")
    kept = toxicity.clean(train.unionByName(odd(spark, False)), labels)
    assert not [r for r in kept.collect() if "nastybar" in (r["text"] or "")]
    assert {1, 2, 3, 4, 6}.issubset({r["doc_id"] for r in kept.collect()})


def test_spans_in_odd_rows(spark):
    found = {r["doc_id"]: r["pii"] for r in pii.find(odd(spark), "text", "pii").collect()}
    assert found[1] == found[2] == found[3] == [] and [s["hit"] for s in found[7]] == ["a.b@ex.org"]
    text = ODD[-1][1]
    assert text[found[7][0]["start"] : found[7][0]["end"]] == "a.b@ex.org"
    assert "[EMAIL]" in {r["doc_id"]: r["text"] for r in pii.redact(odd(spark)).collect()}[7]
    assert pii.redact(odd(spark)).columns == odd(spark).columns
    assert pii.find(odd(spark).limit(0)).count() == 0


def test_long_texts_take_linear_time(spark):
    """A million digits, 50 000 addresses and a long run of token letters, each in one text."""
    import time

    many = " ".join(f"u{k}@ex{k % 7}.org" for k in range(50_000))
    rows = [(1, "7" * 1_000_000), (2, many), (3, "1.2.3." * 200_000), (4, "eyJ" * 300_000), (5, "é" * 200_000 + " call +1 (555) 123-4567 now")]
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.time()
    found = {r["doc_id"]: r["pii"] for r in pii.find(df.where("doc_id <> 4"), "text", "pii").collect()}
    assert [len(found[k]) for k in (1, 2, 3, 5)] == [0, 50_000, 150_000, 1]
    assert found[2][-1]["hit"] == "u49999@ex5.org" and many[found[2][-1]["start"] :] == found[2][-1]["hit"]
    assert found[5][0]["score"] == 0.7 and rows[4][1][found[5][0]["start"] : found[5][0]["end"]] == "+1 (555) 123-4567"
    told = pii.redact(df.where("doc_id = 2")).collect()[0]["text"]
    assert told == " ".join(["[EMAIL]"] * 50_000)
    assert [len(r["spans"]) for r in secrets.scan(df.where("doc_id = 4"), "doc_id").collect()] == [0]
    assert time.time() - began < 60


def test_account_numbers(spark):
    good = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "MT84MALT011000012345MTLCAST001S", "AT61 1904 3002 3457 3201"]
    text = " and ".join(good) + " BANK but not DE89 3704 0044 0532 0130 01"
    found = pii.find(spark.createDataFrame([(1, text)], SCHEMA), "text", "pii").collect()[0]["pii"]
    assert [s["hit"] for s in found if s["kind"] == "iban"] == good
    left = pii.redact(spark.createDataFrame([(1, "a +1 (555) 123-4567 b@c.de ü x@y.z"), (2, None), (3, "")], SCHEMA)).orderBy("doc_id").collect()
    assert [r["text"] for r in left] == ["a [PHONE] [EMAIL] ü [EMAIL]", None, ""]


def brute_spans(text, pattern, kind, ok):
    return [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if ok(m)]


def test_secrets_and_ledger(spark, docs, tmp_path):
    entries = secrets.scan_new(odd(spark), "doc_id")
    texts = {t or "" for _, t in ODD}
    assert entries.count() == len(texts)
    secrets.append_to_ledger(entries, str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    more = odd(spark, False).unionByName(spark.createDataFrame([(50, "token = abcdefghijklmnop")], SCHEMA))
    assert secrets.scan_new(more, "doc_id", ledger).count() == 1
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan(more, "doc_id", ledger).collect()}
    assert [s["kind"] for s in rows[50]] == ["assign"] and [s["kind"] for s in rows[7]] == ["access"]
    path = str(tmp_path / "history")
    history = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan_history(more, "doc_id", path, deliveries=3).collect()}
    assert history == {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(more, "doc_id").collect()}
    blobs = [r["blob"] for r in secrets.read_ledger(spark, path).collect()]
    assert len(blobs) == len(set(blobs)) == len(texts) + 1
    assert secrets.scan_history(more.limit(0), "doc_id", str(tmp_path / "none")).count() == 0
    brute = {k: len(brute_spans(t, r"AKIA[A-Z0-9]+", "access", lambda m: len(m[0]) >= 18)) for k, t in texts_of(docs).items()}
    assert {r["doc_id"]: r["n_access"] for r in secrets.query(spark, SF).collect()} == brute


def test_long_tokens_are_found_whole(spark):
    part = lambda n: "eyJ" + "aZ_-" * (n // 4)
    token = f"{part(1500)}.{part(3000)}.{'s' * 2500}"
    texts = [f"x {token} y", f"-{token}", f"{part(1500)}.eyJshort.{'s' * 20}", "eyJ" * 100_000, f"({token})({token})"]
    found = secrets.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), "doc_id").collect()
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "jwt"] for r in found}
    n = len(token)
    assert spans == {0: [(2, 2 + n)], 1: [], 2: [], 3: [], 4: [(1, 1 + n), (n + 3, 2 * n + 3)]}


def test_history_of_versions(spark, tmp_path):
    """Several versions of a path over several states of the ledger, and a second version of the rules: what is scanned each time, and what each version holds."""
    path, key = str(tmp_path / "ledger"), "doc_id"
    name = lambda rows: spark.createDataFrame([(p, v, t) for p, v, t in rows], "path string, version int, text string").withColumn(key, F.concat_ws("@", "path", "version"))
    a, b = "password = " + "a" * 12, "AKIA" + "B" * 16
    states = [[("x", 1, a), ("y", 1, "none")], [("x", 2, a + " more"), ("y", 2, a), ("z", 1, None)], [("x", 3, a), ("y", 3, b), ("z", 2, ""), ("w", 1, "none")]]
    scanned, seen = [], []
    for n, state in enumerate(states):
        seen += state
        ledger = secrets.read_ledger(spark, path) if n else None
        new = secrets.scan_new(name(seen), key, ledger)
        scanned.append(sorted(r["blob"] for r in new.collect()))
        secrets.append_to_ledger(new, path)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert scanned == [sorted({sha(a), sha("none")}), sorted({sha(a + " more"), sha("")}), [sha(b)]]
    told = secrets.addresses(name(seen), ["path", "version"])
    found = {(r["path"], r["version"]): [s["kind"] for s in r["spans"]] for r in secrets.joined_back(told, secrets.read_ledger(spark, path)).collect()}
    assert found == {(p, v): ["assign"] if t and t.startswith(a) else ["access"] if t == b else [] for p, v, t in seen}
    # Another version of the rules scans every blob once more, and the entries of both stay apart, two for each blob.
    more = secrets.RuleSet("numbers-1", (("digits", "[0-9]{4,}"),))
    secrets.append_to_ledger(secrets.scan_new(name(seen), key, secrets.read_ledger(spark, path), more), path)
    assert secrets.read_ledger(spark, path).groupBy("blob").count().where("count <> 2").count() == 0
    assert secrets.scan_new(name(seen), key, secrets.read_ledger(spark, path), more).count() == 0
    assert {(r["path"], r["version"]): [s["kind"] for s in r["spans"]] for r in secrets.joined_back(told, secrets.read_ledger(spark, path)).collect()} == found


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.report(docs).collect()
    for dim in {r["dim"] for r in rows}:
        own = [r for r in rows if r["dim"] == dim]
        off = sum(abs(r["taken"] - r["target"]) for r in own) / sum(r["target"] for r in own)
        print(f"{dim}: {off:.4f} of the tokens off target, farthest {max(abs(r['taken'] / r['target'] - 1) for r in own if r['target']):.3f}")
        assert off < 0.01
    kept = mixing.sample(odd(spark))
    assert kept.columns == odd(spark).columns and mixing.sample(odd(spark).limit(0)).count() == 0
    told = {r["doc_id"]: (r["mix_source"], r["mix_lang"], r["mix_tokens"]) for r in mixing.mixed(odd(spark)).collect()}
    assert told[1] == told[2] == told[3] == ("s", "", 0) and told[6] == ("s", "", 3000)


def test_mixing_topics_are_whole_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source", "lang")
    chosen = mixing.topic_words(docs)
    runs = {k: Counter(re.findall("[a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))) for k, t in texts_of(docs).items()}
    has = Counter(w for c in runs.values() for w in c if 5 <= len(w) <= 32)
    assert chosen == sorted((w for w in has if has[w] <= 0.2 * len(runs)), key=lambda w: (-has[w], w))[:24]
    for r in mixing.described(docs, words=chosen).collect():
        own = {w: runs[r["doc_id"]][w] for w in chosen if runs[r["doc_id"]][w]}
        assert r["mix_topic"] == max(own, key=lambda w: (own[w], w), default="")


def test_mixing_topics_tied_and_within_longer_words(spark):
    rows = [(1, "Apples apples pears PEARS"), (2, "xapples applesx apples-pears"), (3, "grüne grüne pears"), (4, None), (5, "a" * 300_000 + " pears"), (6, "apple")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"source": F.lit("s"), "lang": F.lit(None).cast("string"), "mix_kept": F.lit(1)})
    found = {r["doc_id"]: r["mix_topic"] for r in mixing.described(docs, words=["apples", "pears", "grüne"]).collect()}
    assert found == {1: "pears", 2: "pears", 3: "grüne", 4: "", 5: "pears", 6: ""}


def test_mixing_with_very_long_words(spark):
    long = [(k, f"{'ab' * 150_000} word{'x' * k} " + "plain words here and there " * 5) for k in range(9)]
    docs = spark.createDataFrame(long, "doc_id bigint, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    assert all(len(w) <= 32 for w in mixing.topic_words(docs))
    began = time.time()
    assert mixing.sample(docs).count() <= 9
    assert time.time() - began < 40


def test_mixing_targets_within_another_margin(spark):
    """Topics' targets are tempered in each language and add up to the languages'."""
    m = {("t1", "x"): 900.0, ("t2", "x"): 100.0, ("t1", "y"): 50.0, ("t3", "y"): 0.0}
    cells = spark.createDataFrame([(t, v, n, 500.0 if v == "x" else 30.0) for (t, v), n in m.items()], "topic string, lang string, tokens double, to_lang double")
    found = {r["topic"]: r["to_topic"] for r in mixing.nested(cells, "topic", "lang", 0.5).collect()}
    assert found["t1"] == pytest.approx(500 - 85 + 30) and found["t2"] == pytest.approx(85) and found["t3"] == 0
    cells = spark.createDataFrame([("s1", t, v, n) for (t, v), n in m.items()], "source string, topic string, lang string, tokens double")
    raked = mixing.rake(cells, ["source", "lang", "topic"], within={"topic": "lang"}).collect()
    assert sum(r["tokens"] * r["weight"] for r in raked) == pytest.approx(525, rel=0.02)


def test_mixing_with_given_targets(spark):
    cells = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 300.0), ("b", "x", 200.0), ("b", "y", 400.0)], "s string, l string, tokens double")
    rows = mixing.rake(cells, ["s", "l"], 0.4, 1.0, targets={"s": {"a": 0.5, "b": 0.5}}).collect()
    taken = {v: sum(r["tokens"] * r["weight"] for r in rows if r["s"] == v or r["l"] == v) for v in "abxy"}
    assert taken["a"] == pytest.approx(200, rel=0.02) and taken["b"] == pytest.approx(200, rel=0.02)
    assert taken["x"] == pytest.approx(120, rel=0.02) and taken["y"] == pytest.approx(280, rel=0.02)
    with pytest.raises(ValueError, match="no target"):
        mixing.rake(cells, ["s", "l"], targets={"s": {"a": 1.0}})


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    model, texts = Tokenizer.from_file(packing.tokenizer_path()), texts_of(docs)
    model.encode_special_tokens = True
    rows = packing.query(spark, SF).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in list(by_doc.items()):
        ids = np.array([*model.encode(texts[doc], add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.02 * total / packing.LENGTH + 2


def test_packing_patterns_place_everything():
    rng = np.random.default_rng(0)
    for _ in range(20):
        hist = {int(n): int(c) for n, c in zip(rng.integers(1, 64, 20), rng.integers(1, 50, 20), strict=True)}
        placed = {}
        for pattern, count in packing.patterns(hist, 64):
            assert sum(pattern) <= 64
            for n in pattern:
                placed[n] = placed.get(n, 0) + count
        assert placed == hist


def test_packing_odd_rows(spark):
    rows = packing.pack(packing.pieces(odd(spark))).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows}[1] == 1 and len([r for r in rows if r["doc_id"] is None]) == 1
    assert packing.pack(packing.pieces(odd(spark).limit(0))).count() == 0


def test_warc_round_trip_and_faults(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (None, "u", "solo")], "page_id bigint, url string, html string")
    folder = str(tmp_path / "warc")
    written = warc.write_archives(pages.withColumn("d", F.lit(1)).withColumn("refers_to", F.lit("x")), f"file://{folder}")
    (tmp_path / "warc" / "lost-attempt.warc.zst").write_bytes(b"half of an archive")
    rows = warc.read_archives(spark, f"file://{folder}", written).collect()
    assert len(rows) == 6
    with pytest.raises(ValueError, match="missing"):
        warc.read_archives(spark, f"file://{folder}", written.unionByName(spark.createDataFrame([("gone", 1)], written.schema)))
    with pytest.raises(Exception, match="instead of"):
        warc.read_archives(spark, f"file://{folder}", written.withColumn("records", F.col("records") + 1)).collect()
    none = warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none", none).count() == 0
    of = {r["page_id"]: r for r in rows}
    assert of[1]["refers_to"] == 4 and of[2]["refers_to"] == 3 and of[4]["record_type"] == "response" and of[1]["payload_bytes"] == 9
    assert bytes(of[4]["payload"]).decode() == "<p>é</p>"
    good = warc.archive([warc.record(1, "u", b"abc" * 50, warc.digest_of(b"abc" * 50), 150, None)])
    assert len(list(warc.read_archive(good))) == 1
    for bad in (good[:-4], b"\0" * 8 + good[8:]):
        with pytest.raises(Exception):  # noqa: B017  a frame cut short, or no dictionary
            list(warc.read_archive(bad))
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")


def brute_substrings(texts, n=13):
    first, out = {}, {}
    for k in sorted(texts):
        w = words(texts[k])
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), k)
    for k, t in texts.items():
        w, gone = words(t), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < k:
                gone.update(range(i, i + n))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substrings_against_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(40)]
    made = {k: " ".join([*(f"w{x}" for x in rng.integers(0, 6, int(rng.integers(0, 60)))), *passage[int(a := rng.integers(0, 30)) : int(a + rng.integers(0, 30))], *(f"w{x}" for x in rng.integers(0, 3, 30))]) for k in range(80)}
    for texts in (made, texts_of(docs)):
        df = spark.createDataFrame(list(texts.items()), SCHEMA)
        found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(df).collect()}
        assert found == brute_substrings(texts)


def test_substrings_with_colliding_hashes():
    """Windows that share the hash that deals them out are told apart by the second one."""
    value, check = np.array([5, 5, 5, 5], np.uint64), np.array([1, 1, 2, 2], np.uint32)
    known, ask = substrings.standing(value, check, np.array([3, 8, 4, 4]), np.ones(4, dtype=bool), both=False)
    assert known.tolist() == [False, True, False, False] and ask.tolist() == [True, False, True, True]
    found, words = substrings.words_of(substrings._Words(), b" ".join(b"w%d" % k for k in range(40)))
    own, other = substrings.rolling(words, 13), substrings.second(substrings.hashed(substrings._Words(xxhash.xxh3_64_intdigest), found), 13)
    assert len(set(other.tolist())) == len(own) and other.dtype == np.uint32
    row = substrings.packed(np.array([4, 4, 9]), 7, own[:3], other[:3], np.array([True, False, True]))
    doc, value, check, block = substrings.opened(*row[1:], wide=True)
    assert doc.tolist() == [4, 4, 9] and (value == own[:3]).all() and (check == other[:3]).all() and block.tolist() == [True, False, True]
    assert substrings.repeated_runs(words, own[2:5].tobytes()) == [(2, 17)]
    assert substrings.repeated_runs(words, own[[0, 20]].tobytes()) == [(0, 13), (20, 33)]


def test_substrings_buckets_grow_with_the_text_not_in_size(spark, docs):
    small = substrings.bucket_count(docs.select("text"), "text", 1 << 12)
    double = substrings.bucket_count(docs.select("text").unionByName(docs.select("text")), "text", 1 << 12)
    assert small > 50 and abs(double - 2 * small) <= 2
    texts = texts_of(docs)
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    few, many = ({r["doc_id"]: r["kept"] for r in substrings.dedup(df, bucket_bytes=b).collect()} for b in (1 << 30, 1 << 14))
    assert few == many


def test_substrings_give_maximal_repeats(spark):
    shared = [f"s{k}" for k in range(30)]
    texts = {1: "a b " + " ".join(shared) + " c", 2: "x " + " ".join(shared) + " y z " + " ".join(shared[4:20]) + " q", 3: " ".join(shared[:12])}
    found = {r["doc_id"]: [(x["start"], x["end"]) for x in r["repeats"]] for r in substrings.dedup(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    assert found == {1: [], 2: [(1, 31), (33, 49)], 3: []}


def test_substrings_odd_rows(spark):
    rows = substrings.dedup(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r["n_removed"] == 0 for r in rows)
    assert substrings.dedup(odd(spark).limit(0)).count() == 0


@pytest.fixture(scope="module")
def near_vectors_planted():
    """ids and vectors: a cloud, 300 partners at cosines from 0.95 to 0.97, and a tight cluster of 1300 about one of them."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(2400, 48)) * np.linspace(2, 0.5, 48))
    away = lambda v: unit((w := rng.normal(size=v.shape)) - (w * v).sum(-1, keepdims=True) * v)
    cos = rng.uniform(0.951, 0.97, (300, 1))
    planted = cos * base[:300] + np.sqrt(1 - cos**2) * away(base[:300])
    hot = unit(np.tile(base[7], (1300, 1)) + 0.15 * away(np.tile(base[7], (1300, 1))))
    v = np.concatenate([base, planted, hot])
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    return np.arange(len(v)) * 3 + 1, v, near


@pytest.mark.parametrize("leaf", [forest_dedup.LEAF, 32, 2])
def test_forest_recall_against_brute_force(spark, near_vectors_planted, leaf):
    """Recall of links in forests of depth 4, 7 and 11, the last beyond the levels whose nodes have medians of their own."""
    ids, v, near = near_vectors_planted
    df = spark.createDataFrame(list(zip(ids.tolist(), v.tolist(), strict=True)), "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in forest_dedup.near_vectors(df, leaf=leaf).collect()}
    want = near.sum(axis=1)
    rows = forest_dedup.Forest(v, len(v), leaf=leaf)
    print(f"depth {rows.depth}: {sum(found.values())} of {want.sum()} links, {len(rows.leaves(v)[0]) / len(v):.1f} leaves a vector, largest {np.unique(rows.leaves(v)[1], return_counts=True)[1].max()}")
    assert all(found[i] <= n for i, n in zip(ids.tolist(), want.tolist(), strict=True))
    alone = np.arange(len(v)) < 2700
    assert want[alone].sum() > 500 and sum(found[i] for i in ids[alone].tolist()) >= 0.97 * want[alone].sum()
    assert sum(found.values()) >= 0.97 * want.sum()


def test_forest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0])]
    found = forest_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("n_links", F.lit(0))).collect()
    assert len(found) == len(rows)
    links = {r["vec_id"]: r["n_links"] for r in found if r["vec_id"] not in (2, None)}
    assert links == {1: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 2, 10: 0}
    assert {r["component_id"] for r in found if r["vec_id"] in (1, 9)} == {1}
    assert forest_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_forest_at_extreme_magnitudes(spark):
    tiny = 5e-324
    rows = [(1, [1e-200, 2e-200]), (2, [1.0, 1.0]), (3, [1e200, 1e200]), (4, [2e200, 2e200]), (5, [tiny, 0.0]), (6, [1.0, 0.1]), (7, [1.7e308, 1.7e308]), (8, [3.0, 6.0]), (9, [tiny, tiny]), (10, [-1e308, 0.0])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert found == {1: (1, 1), 8: (1, 1), 2: (4, 2), 3: (4, 2), 4: (4, 2), 7: (4, 2), 9: (4, 2), 5: (1, 5), 6: (1, 5), 10: (0, 10)}
