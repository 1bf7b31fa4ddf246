"""Rows of one time: slopes as SQL has them, no value in blocks, and samples taken in order."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import drivers, series
from tracegrid.plans import catalogue

T = [0.0, 1.0, 1.0, 1.0, 2.0, 3.0, 5.0, 6.0, 6.0]
X = [1.0, 3.0, 2.0, 2.0, 5.0, 4.0, 8.0, 7.0, 9.0]


def test_gradient_is_finite_where_numpys_is(spark):
    rows = spark.createDataFrame([(s, k, t, x) for s in (1, 2) for k, (t, x) in enumerate(zip(T[2 * s - 2 :], X[2 * s - 2 :], strict=True))], "s int, pos bigint, t double, x double")
    for s in (1, 2):
        got = np.array([r["g"] for r in series.gradient(rows.where(F.col("s") == s), ["s"], "pos", "x", "g", "t", chunk=3).orderBy("pos").collect()])
        with np.errstate(all="ignore"):
            want = np.gradient(X[2 * s - 2 :], T[2 * s - 2 :])
        known = np.isfinite(want)
        assert known.any() and not known.all() and (np.isfinite(got) == known).all()
        assert np.allclose(got[known], want[known])


@pytest.mark.parametrize("name", ["q11_gradient_nonuniform", "q125_motion_features"])
def test_query_matches_sql(spark, tmp_path, name):
    # User 0 has one time alone; in the others' values equal, rising and falling steps take no time.
    kinds = ["view", "click", "error", "view"]
    rows = [(10 * u + k, dt.datetime(2024, 1, 1, 5) + dt.timedelta(seconds=t if u else 0), u, kinds[(u + k) % 4], x * (1 - 2 * (u == 2))) for u in range(4) for k, (t, x) in enumerate(zip(T, X, strict=True)) if u != 3 or k < 3]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    df = catalogue.queries()[name](spark, str(tmp_path))
    told = lambda rs: sorted(repr(tuple(float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v for v in r)) for r in rs)
    want = told(con.sql(catalogue.oracle_sql()[name]).select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall())
    assert any("inf" in w for w in want) and any("nan" in w for w in want)
    assert told(df.collect()) == want


def test_blocks_have_no_slope_where_time_stands_still(spark):
    n = len(T)
    beh = spark.createDataFrame([(k, T[k], X[k], X[-k], 0.1 * k, float(k)) for k in range(n)], "pos bigint, t double, x double, z double, heading double, count double")
    at = [0.5, 1.0, 1.25, 2.5, 4.0, 5.5, 9.0]
    frames = spark.createDataFrame([(a,) for a in at], "at double")
    view = spark.createDataFrame([(k, 0, X[k] / 10, X[k] / 20, X[k]) for k in range(n)], "pos bigint, obj_id int, lat double, vert double, dist double")
    pictures = spark.createDataFrame([(k, [X[k], 2 * X[k], -X[k]]) for k in range(n)], "pos bigint, v array<double>")
    blocks = drivers.feature_blocks({"R": view}, beh, frames, [], "pos", "t", "at", 1.5, 10.0, "raw", pictures=pictures, n_pix=2, pix_slopes=0.0, motion=0.0, self_moving=0.0, counts=["count"], bucket=2.0)
    found = {name: {r["at"]: r for r in df.collect()} for name, df in blocks.items()}
    assert all(sorted(rows) == at for rows in found.values())
    with np.errstate(all="ignore"):
        slope = np.gradient(np.array(X) / 10, T)
    assert np.flatnonzero(~np.isfinite(slope)).tolist() == [1, 2, 3, 7, 8]
    want = {2.5: (slope[4] + slope[5]) / 2, 4.0: (slope[5] + slope[6]) / 2} | dict.fromkeys((0.5, 1.0, 1.25, 5.5, 9.0))
    for a, w in want.items():
        moving, turning = found["motion"][a], found["pix_mot"][a]["v"]
        assert all((v is None) == (w is None) for c, v in moving.asDict().items() if c != "at") and (turning is None) == (w is None)
        if w is not None:
            assert moving["d_lat_R"] == pytest.approx(w) and len(turning) == 2
    # The last of the rows at or before a frame, the first of those at or after it.
    assert found["beh"][1.25]["count"] == 3.0 and found["beh"][1.0]["count"] == 3.0 and found["beh"][9.0]["count"] == 8.0
    assert found["agg"][0.5]["lat_R"] == pytest.approx((X[0] + X[1]) / 20) and found["agg"][5.5]["lat_R"] == pytest.approx((X[6] + X[7]) / 20)
    assert found["agg"][1.25]["lat_R"] == pytest.approx((X[3] * 0.75 + X[4] * 0.25) / 10)
