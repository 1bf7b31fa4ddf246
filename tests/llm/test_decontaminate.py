"""Decontamination against brute force, in odd cases, and with several automata."""

import hashlib
import re

from pyspark.sql import functions as F

from tracegrid.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window):
    """(n_words, n_hit, items, spans) for each text."""
    pairs = set()
    for item, text in items:
        w = WORD.findall(low(text))
        pairs |= {(tuple(w[i : i + window]), "" if item is None else str(item)) for i in range(max(1, len(w) - window + 1)) if w}
    out = []
    for text in docs:
        at = [m.span() for m in WORD.finditer(low(text))]
        w = [low(text)[a:b] for a, b in at]
        hit, met = [False] * len(w), set()
        for g, item in pairs:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit[i : i + len(g)] = [True] * len(g)
                    met.add(item)
        starts = [i for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1])]
        ends = [next((j for j in range(i, len(hit)) if not hit[j]), len(hit)) for i in starts]
        out.append((len(w), sum(hit), sorted(met), [(at[a][0], at[b - 1][1]) for a, b in zip(starts, ends, strict=True)]))
    return out


ITEMS = [(1, "a b c d e"), (10, "C D, e f"), (2, "x"), (3, "é ÉÜ z9"), (None, "q r s"), (4, None), (5, "...!?"), (6, "a b a b a b a"), (7, "b c d"), (7, "m n o p")]
DOCS = ["a b c d e", "A-B-C.D\nE F", None, "", "?! --", "xx x yé é ÉÜ z9", "b a b a b a b a b", "q r s q r s", "m n o p m n o", "ÉÜ É éÜ " * 3 + "é ÉÜ Z9 c", "w " * 5000 + "a b c " + "w " * 5000, "c d e"]


def rows(found):
    return sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_hit"], r["items"], [(s["start"], s["end"]) for s in r["spans"]]) for r in found.collect())


def frames(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(DOCS)] + [(3, ""), (0, "a b c d e")], "doc_id int, text string")
    docs = docs.withColumns({"row": F.lit(1), "items": F.lit("x"), "window": F.lit(None).cast("string"), "item_id": F.lit(2)})
    return docs, spark.createDataFrame(ITEMS, "item_id int, text string").withColumns({"doc_id": F.lit(1), "item": F.lit(7)})


def test_against_brute_force_with_one_automaton_and_many(spark):
    docs, items = frames(spark)
    for window in (3, 10):
        told = brute(DOCS, ITEMS, window)
        want = sorted((False, k, *told[k]) for k in [*range(len(DOCS)), 3, 0])
        assert rows(decontaminate.contaminated(docs, items, window=window)) == want
        assert rows(decontaminate.contaminated(docs, items, window=window, pattern_bytes=200)) == want


def test_fields_of_questions_and_answers(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, "three four")], "doc_id int, text string")
    items = spark.createDataFrame([(9, "One two three?", "Four five six!")], "item_id int, question string, answer string")
    found = decontaminate.contaminated(docs, items, fields=("question", "answer"))
    assert [(r["n_hit"], r["items"]) for r in found.orderBy("doc_id").collect()] == [(3, ["9"]), (3, ["9"]), (0, [])]


def test_empty_tables_and_null_ids(spark):
    docs, items = frames(spark)
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).agg(F.sum("n_hit")).collect()[0][0] == 0
    one = decontaminate.contaminated(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")), items).collect()
    assert [(r["doc_id"], r["n_hit"]) for r in one] == [(None, 4)]


def test_query_on_a_small_table(spark, tmp_path):
    docs, items = frames(spark)
    docs.select("doc_id", "text").where("doc_id not in (0, 3)").write.parquet(f"{tmp_path}/documents.parquet")
    items.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in decontaminate.query(spark, str(tmp_path)).collect()}
    told = brute(DOCS, ITEMS, 10)
    for k, r in found.items():
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (told[k][0], told[k][1], len(told[k][2]), told[k][1] > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(told[k][2]).encode()).hexdigest()
