"""Operators that no query calls, against plain Python and NumPy, and ranks of whole tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import asof, blocks, decoding, ensembles, features, linalg, ordered, scene
from tracegrid.sources import sessions
from tracegrid.streaming import counts


def vectors(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "frame bigint, v array<double>")


def test_ranks_of_whole_tables(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=500), 1)
    x[:200] = 0.3  # ties and a hot value
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)] + [(500, None)], "k int, x double").repartition(5)
    want = [500, *sorted(range(500), key=lambda k: (x[k], k))]
    for parts in (1, 7, 64):
        assert [r["k"] for r in sorted(ordered.ranked(df, "x", ["k"], "rank", parts).collect(), key=lambda r: r["rank"])] == want
    assert ordered.ranked(df.limit(0), "x", ["k"], "rank").count() == 0


def test_cells_and_components(spark):
    rng = np.random.default_rng(2)
    drive = rng.normal(size=(300, 1))
    x = np.hstack([drive + 0.3 * rng.normal(size=(300, 5)), rng.normal(size=(300, 3))])
    df = vectors(spark, x)
    assert 1 <= ensembles.significant_components(df, "v", 4) < 3
    null = [vectors(spark, np.stack([np.roll(c, int(s)) for c, s in zip(x.T, rng.integers(0, 300, 8), strict=True)], axis=1)) for _ in range(8)]
    assert set(range(5)) <= set(ensembles.correlated_cells(df, null, "v", 95.0))
    loads = spark.createDataFrame([("a", 0.1), ("a", 0.9), ("b", 0.9), ("c", -1.0), ("d", 2.0)], "cell string, value double")
    assert {r["cell"]: r["rank"] for r in ensembles.ranked_cells(loads, "cell", "value").collect()} == {"d": 1, "a": 2, "b": 3, "c": 4}
    a = linalg.principal(df, "v", 3)
    flipped = linalg.Components(-a.loadings[[2, 0, 1]], a.mean, a.variances)
    match, corr = ensembles.stability(a, flipped)
    assert match == [1, 2, 0] and np.allclose(corr, 1)


def test_scores_of_folds(spark):
    rows = [(k, k % 2, float(k % 3), float(k % 3) + (0.5 if k % 5 else -0.5)) for k in range(40)]
    oof = spark.createDataFrame(rows, "pos int, fold int, y double, pred_y double")
    fit = decoding.pooled_fit(oof, "y").collect()[0]
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    slope = np.cov(y, p, bias=True)[0, 1] / y.var()
    assert tuple(fit) == pytest.approx((slope, p.mean() - slope * y.mean(), 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()))
    found = {r["fold"]: r["auc"] for r in decoding.auc_by_fold(oof, "y").collect()}
    for f in (0, 1):
        a, b = ([r[3] for r in rows if r[1] == f and (r[2] > 0) == up] for up in (True, False))
        assert found[f] == pytest.approx(np.mean([(q > s) + 0.5 * (q == s) for q in a for s in b]))
    order = decoding.chunk_order(10, 3, 1)
    assert sorted(order) == sorted(order.values()) == [0, 1, 2, 3]


def test_penalty_with_the_least_error(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 12))
    y = x[:, 0] + 3 * rng.normal(size=60)
    df = spark.createDataFrame([(k, [*map(float, x[k]), float(y[k])]) for k in range(60)], "pos bigint, v array<double>")
    edges, grid = decoding.fold_edges(60), [0.01, 1.0, 100.0, 1e4]
    trained = decoding.training(df, "v", "pos", edges, 0)
    tested = linalg.moments(df.withColumn("f", F.floor(F.col("pos") / 12)), "v", "f")

    def error(alpha):
        total = 0.0
        for f in range(5):
            test = np.arange(60) // 12 == f
            m, s = x[~test].mean(0), x[~test].std(0)
            w = np.linalg.solve(((x[~test] - m) / s).T @ ((x[~test] - m) / s) + alpha * np.eye(12), ((x[~test] - m) / s).T @ (y[~test] - y[~test].mean())) / s
            total += ((y[test] - (x[test] - m) @ w - y[~test].mean()) ** 2).sum()
        return total

    assert decoding.best_alpha(trained, tested, 12, grid) == min(grid, key=error)


def test_scene_helpers(spark):
    view = spark.createDataFrame([(1, 0.5), (1, 3.0), (2, 2.0), (3, 0.9)], "frame int, dist double")
    assert sorted(r["frame"] for r in scene.near_frames(view, ["frame"], 1.0).collect()) == [1, 3]
    rng = np.random.default_rng(4)
    cells = [(float(i), float(j), float(rng.normal())) for i in range(6) for j in range(6)]
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(1, 4, (30, 2)))]
    near = lambda a, b: min(cells, key=lambda c: (math.hypot(c[0] - a, c[1] - b), c[1], c[0]))[2]
    df = spark.createDataFrame([(k, a, b, near(a + 1, b) + 0.4) for k, a, b in points], "k int, x double, z double, y double")
    grid = spark.createDataFrame(cells, "x double, z double, height double")
    offsets = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0)], "ox double, oz double")
    found = {(r["ox"], r["oz"]): r for r in scene.offset_sweep(df, grid, offsets, ["k"], "height", "y").collect()}
    assert (found[1.0, 0.0]["mean"], found[1.0, 0.0]["std"], found[1.0, 0.0]["median"]) == pytest.approx((0.4, 0.0, 0.4))
    delta = [near(a + 1, b) + 0.4 - near(a, b) for _, a, b in points]
    assert (found[0.0, 0.0]["mean"], found[0.0, 0.0]["std"]) == pytest.approx((np.mean(delta), np.std(delta)))


def test_movement_frames(spark):
    t = np.arange(0, 3, 0.25)
    samples = spark.createDataFrame([(float(s), float(s), 0.0, float(s * s), float(2 * s)) for s in t], "time double, x double, y double, z double, heading double")
    spine = spark.createDataFrame([(k, 0.1 + 0.4 * k) for k in range(6)], "pos bigint, at double")
    rows = sorted(features.movement_frame(spine, samples, [], "at", "time", "pos").collect(), key=lambda r: r["pos"])
    at = np.array([0.1 + 0.4 * k for k in range(6)])
    x, z = np.interp(at, t, t), np.interp(at, t, t * t)
    turn = np.arctan2(np.interp(at, t, np.sin(2 * t)), np.interp(at, t, np.cos(2 * t)))
    assert np.allclose([(r["x"], r["z"], r["heading"]) for r in rows], np.stack([x, z, turn], axis=1))
    step = np.arctan2(np.sin(np.diff(turn)), np.cos(np.diff(turn)))
    assert np.allclose([(r["d_dist"], r["d_phi"]) for r in rows[1:]], np.stack([np.hypot(np.diff(x), np.diff(z)), step], axis=1)) and rows[0]["d_dist"] is None
    moved = spark.createDataFrame([(k, 0.3 * k, 0.4 * k, (0.2 * k + math.pi) % (2 * math.pi) - math.pi) for k in range(60)], "pos bigint, x double, z double, heading double")
    inner = {r["pos"]: (r["speed"], r["yaw_rate"]) for r in features.self_motion(moved, [], "pos").collect()}
    assert all(inner[k] == pytest.approx((5.0, 2.0)) for k in range(12, 48))


def test_normalised_traces(spark):
    df = spark.createDataFrame([("a", k, 3.0 + math.sin(k / 9)) for k in range(80)] + [("b", 0, 2.0)], "s string, pos bigint, v double")
    rows = {(r["s"], r["pos"]): r["n"] for r in features.normalised_trace(df, ["s"], "pos", "v", "n", 1.0).collect()}
    x = np.sin(np.arange(80) / 9)
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    y = np.convolve(np.pad(x, 4, mode="symmetric"), w / w.sum(), "valid")
    assert np.allclose([rows["a", k] for k in range(80)], y / y.std())
    cuts = spark.createDataFrame([(3, 5), (9, 9)], "a bigint, b bigint")
    assert [r["frame"] for r in asof.kept_frames(cuts, "a", "b").orderBy("frame").collect()] == [2, 3, 4, 8]


def test_blocks(spark):
    @blocks.extractor("doubled", "twice a column", by=2)
    def doubled(df, by):
        return df.select("k", (F.col("x") * by).alias("y"))

    df = spark.createDataFrame([(k, float(k), None if k == 2 else 1.0 * (k % 2)) for k in range(4)], "k int, x double, z double")
    assert sorted(r["y"] for r in blocks.extracted("doubled", df).collect()) == [0, 2, 4, 6] and sorted(r["y"] for r in blocks.extracted("doubled", df, by=3).collect()) == [0, 3, 6, 9]
    with pytest.raises(KeyError):
        blocks.extracted("none", df)
    told = sorted(blocks.supervision({"a": df.select("k", "x"), "b": df.select("k", "z")}, ["a", "b"], ["k"], []).collect())
    z = np.array([0, 1, 0, 1.0])
    assert np.allclose([(r["a_x"], r["b_z"]) for r in told], np.stack([(np.arange(4) - 1.5) / np.std(np.arange(4)), (z - z.mean()) / z.std()], axis=1))
    assert blocks.without_presence(df.withColumn("pres_L", F.lit(1))).columns == ["k", "x", "z"]
    with pytest.raises(ValueError):
        blocks.without_presence(df.select(F.lit(1).alias("pres_L")))
    assert blocks.complete(df, ["z"]).count() == 3


def test_session_tables(spark, tmp_path):
    for name, n in (("m1_2024_1_2_3h_4m", 5000), ("m2", 3)):
        (tmp_path / f"{name}_Events.csv").write_text("Time,event\n" + "".join(f"{k / 10},e{k}\n" for k in range(n)))
    (tmp_path / "notes.txt").write_text("x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # so that one file is read in several splits
    try:
        rows = sessions.table(spark, str(tmp_path), "Events")
        found = {(r["session"], r["row"]): r["event"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 5003 and all(e == f"e{k}" for (_, k), e in found.items())
    assert sorted(r["name"] for r in sessions.files(spark, str(tmp_path), [".csv"], ["m1"]).collect()) == ["m1_2024_1_2_3h_4m_Events.csv"]
    tags = spark.createDataFrame([("m1_2024_1_2_3h_4m",), ("m2",)], "s string").select(sessions.started(F.col("s")).cast("string").alias("t")).collect()
    assert [r["t"] for r in tags] == ["2024-01-02 03:04:00", None]
    quality = spark.createDataFrame([(1, 0.5, 1.6, 0.8), (2, 0.5, 1.5, 0.8), (3, None, 9.0, 9.0)], "k int, r_values double, snr double, cnn double")
    assert [r["k"] for r in sessions.good_components(quality).collect()] == [1]
    first = spark.createDataFrame([("a", 1, float("nan")), ("a", 2, 5.0), ("b", 1, 7.0)], "s string, k int, v double")
    assert {r["s"]: r["v"] for r in sessions.first_value(first, ["s"], "k", "v").collect()} == {"a": 0.0, "b": 7.0}


def test_streaming_counts(spark, tmp_path):
    """A stream of three files gives the counts that a batch over all of them gives."""
    rows = [(f"2024-01-01 0{h}:1{m}:00", u, kind) for h in range(3) for m in range(4) for u in (1, 2) for kind in ("click", "view")][: 3 * 16]
    source = tmp_path / "in"
    for n in range(3):
        spark.createDataFrame(rows[n * 16 : n * 16 + 16], "at string, user int, kind string").selectExpr("to_timestamp(at) as ts", "user", "kind").coalesce(1).write.mode("append").parquet(str(source))
    batch = spark.read.parquet(str(source))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    wanted = {"clicks": F.col("kind") == "click", "views": F.col("kind") == "view"}
    for name, df, mode in (("hours", counts.window_counts(stream, ["user"], "ts", wanted), "complete"), ("totals", counts.session_totals(stream, ["user"], wanted), "complete")):
        query = df.writeStream.format("memory").queryName(f"reach_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        by = ["user", F.window("ts", "1 hour")["start"].alias("start")] if name == "hours" else ["user"]
        want = batch.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in wanted.items()])
        assert sorted(map(tuple, spark.table(f"reach_{name}").collect())) == sorted(map(tuple, want.collect()))
