"""Hard negatives against brute force: clusters, copies, ties, groups of anchors, and rows that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import hard_negatives


def brute(rows, asked=100, low=30, high=90):
    """Sorted results for (id, label, vector), by whole numbers only."""
    some = [(i, lab, [math.floor(256 * float(c)) for c in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, lab, v in some:
        if a % asked:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), b, other) for b, other, w in some if b != a and len(w) == len(v)]
        for p, pos, _ in sorted(s for s in scores if s[2] == lab)[:5]:
            found = sorted(s for s in scores if s[2] != lab and low * -p <= 100 * -s[0] <= high * -p)[:10]
            out += [(a, pos, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, None if v is None else [None if c is None else float(c) for c in v]) for i, lab, v in rows], "vec_id bigint, label int, embedding array<double>")


@pytest.mark.parametrize("dim", [1, 5, 16])
def test_against_brute_force(spark, dim, monkeypatch):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, 900)] + 0.2 * rng.normal(size=(900, dim))
    v[300:600] = v[7]  # a third are copies of one vector, so that scores tie
    rows = [(int(k), int(rng.integers(0, 3)), v[k].tolist()) for k in range(900)]
    monkeypatch.setattr(hard_negatives, "CHUNK", 128)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    found = hard_negatives.hard_negatives(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in found) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(500, 7))).astype(np.int64)
    books = hard_negatives.codebooks(v[:300].astype(np.float64), sub=2, centroids=16)
    asked = hard_negatives.Asked(np.arange(9), np.zeros(9, np.int64), v[:9], books)
    score, reach = asked.bounds(slice(0, 9), *books.encode(v))
    assert (np.abs(v[:9] @ v.T - score) <= reach).all()
    assert reach.mean() < 0.2 * np.abs(v[:9] @ v.T).mean() + reach.max()


def test_odd_rows_take_no_part(spark):
    rows = [(0, 1, [1, 0.5]), (1, 1, [1, 0.25]), (2, 2, [0.5, 0.5]), (3, 2, None), (4, None, [1, 1]), (None, 2, [1, 1]), (5, 2, [float("nan"), 1]), (6, 2, [float("inf"), 1]), (7, 2, [None, 1]), (8, 2, []), (9, 2, [1, 2, 3]), (10, 2, [0, 0]), (100, 3, [1, 1]), (200, 1, [-1, -1])]
    df = frame(spark, rows + [(2, 2, [0.5, 0.5])]).withColumns({"id": F.lit(3), "score": F.lit(1), "place": F.lit(None).cast("string")})
    found = hard_negatives.hard_negatives(df)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_ids_that_repeat_and_huge_components(spark):
    rows = [(0, 1, [1e300, 1e300]), (1, 1, [1e300, 1e300]), (2, 2, [1e300, 0.0])]
    found = hard_negatives.hard_negatives(frame(spark, [*rows, (2, 3, [5.0, 5.0])])).collect()
    assert [(r["anchor_id"], r["positive_id"], r["negative_id"]) for r in found] == [(0, 1, 2)]
