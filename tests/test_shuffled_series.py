"""q53 against brute force over series of different lengths."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracegrid.operators.decoding import drawn_shifts
from tracegrid.plans import catalogue


def test_whole_series_are_shifted(spark, tmp_path):
    series = {user: [float((7 * k * k + user) % 101) for k in range(n)] for user, n in ((1, 1), (2, 5), (3, 40), (4, 67), (5, 99), (6, 250))}
    start = dt.datetime(2024, 1, 1)
    rows = [(1000 * u + k, u, v, start + dt.timedelta(hours=5 * k)) for u, x in series.items() for k, v in enumerate(x)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    sizes = spark.createDataFrame([(u, len(x)) for u, x in series.items()], "user_id bigint, n bigint")
    shifts = {(r["draw"], r["user_id"]): r["shift"] for r in drawn_shifts(sizes, "user_id", 3, "n", 2).collect()}
    assert any(s >= 40 for s in shifts.values()) and all(2 <= s <= max(2, len(series[u]) - 3) for (_, u), s in shifts.items())
    want = {}
    for (draw, user), shift in shifts.items():
        x = series[user]
        moved = [x[(k - shift) % len(x)] for k in range(len(x))]
        half = [v for k, v in enumerate(moved) if k < len(x) / 2]
        want[draw, user] = sum(half) / len(half)
    found = {(r["draw"], r["user_id"]): r["mean"] for r in catalogue.queries()["q53_shuffled_series"](spark, str(tmp_path)).select("draw", "user_id", F.col("mean")).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-6) for k in want)
