"""The pipeline's stages on the smallest table, each against its own input."""

import re
import time

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    columns = docs.columns
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.collect()}
        assert seen[name] <= {r["doc_id"] for r in before.collect()}
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert seen["pii"] == seen["simhash"] and seen["packing"] == seen["mixing"] and 0 < len(seen["mixing"]) < len(seen["pii"])
    # Equal texts leave one document; documents whose five-word shingles share little with all others stay.
    clean = spark.read.parquet(str(tmp_path / "toxicity"))
    texts = {r["doc_id"]: r["text"] or "" for r in clean.collect()}
    shingles = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, re.findall("[^\x20\x09-\x0d]+", t)) for k, t in texts.items())}
    like = lambda a, b: len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
    ids = sorted(texts)
    for a in ids:
        near = [b for b in ids if b != a and like(a, b) >= 0.3]
        if not near:
            assert a in seen["simhash"]
        for b in near:
            if like(a, b) >= 0.95:
                assert not (a in seen["simhash"] and b in seen["simhash"])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lost = set(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()) - seen["toxicity"]
    assert labels.where(F.col("doc_id").isin(list(lost)) & (F.col("toxic") == 0)).count() <= 0.1 * labels.count()


def test_odd_tables(spark, tmp_path):
    """Null, empty, repeated and very long rows, columns with the stages' own names, and an empty table, through all stages."""
    plain = "several plain words that stand here for a text of some length and say nothing much at all"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, plain), (4, plain), (5, plain.upper()), (6, "ab" * 150_000), (7, "word " * 30_000), (8, "mail me: a.b@example.org or +44 20 7946 0958"), (None, "a text without an id"), (9, "ünï çødé " * 40)]
    columns = "lang string, source string, n_chars bigint, mix_topic string, score double, component_id int, fp int, ids array<int>, toxic int"
    docs = spark.createDataFrame([(*r, None, "s" if r[0] != 8 else None, None, "x", 0.5, 3, 4, [1], 1) for r in rows], f"doc_id bigint, text string, {columns}")
    labels = spark.createDataFrame([(4, 1, 0), (7, None, 1), (None, 1, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    began = time.time()
    for name, some in (("odd", docs), ("empty", docs.limit(0))):
        folder = tmp_path / name
        some.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        if name == "empty":
            assert not out
        else:
            assert {r["doc_id"] for r in out} <= {r[0] for r in rows} and not (4 in {r["doc_id"] for r in out} and 5 in {r["doc_id"] for r in out})
            for doc in {r["doc_id"] for r in out} - {None, 4}:
                parts = sorted((r["start"], r["length"]) for r in out if r["doc_id"] == doc)
                assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert time.time() - began < 240


def test_stages_on_odd_rows(spark):
    """What each stage but the last keeps of such a table, with all its columns."""
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b c d e f", "x"), (4, "A B c d e f", "x"), (None, "a b c d e f", "x")], "doc_id bigint, text string, component_id string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(1).cast("bigint")})
    kept = corpus_pipeline.near_copies(spark, docs, SF)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]
    assert corpus_pipeline.near_copies(spark, docs.limit(0), SF).count() == 0 and corpus_pipeline.near_copies(spark, docs.limit(1), SF).count() == 1
    masked = corpus_pipeline.personal_data(spark, docs.withColumn("text", F.lit("x a.b@c.org")), SF).collect()
    assert all("@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in masked)
