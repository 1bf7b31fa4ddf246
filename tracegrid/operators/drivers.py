"""Composites: blocks of features on one clock, motion of what is in view, tuning to trial types, thresholds from null draws.

Sessions are ``by``, positions are dense from 0. A frame that shows nothing has presence 0 and NULL for what else its side
would tell. Everything is read off at the other clock's times: presence and counts from the nearest sample, the rest
along the line between two.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.columns import angular_size, finite
from tracegrid.operators import scene
from tracegrid.operators.asof import interpolated
from tracegrid.operators.factors import non_negative, row_weights, start
from tracegrid.operators.features import event_features, self_motion
from tracegrid.operators.linalg import Components, mapped, moments, principal, scores
from tracegrid.operators.movies import read_off
from tracegrid.operators.ordered import joined, windowed
from tracegrid.operators.series import gradient, peak, smoothed, triggered
from tracegrid.operators.settle import settled
from tracegrid.operators.stats import quantiles


def motion_features(side: DataFrame, by: list[str], pos: str, time: str, size: float | None = None, sigma: float = 2.0, nearest: str | None = None) -> DataFrame:
    """(by, pos, time, d_lat, d_vert, d_dist[, d_ang_size], motion_mag, motion_dir_sin, motion_dir_cos) from presence, lat, vert and dist.

    Gradients per second of the smoothed place, not finite at rows of one time; 0 where nothing is in view. size: half-width
    for the growth of the angle it is seen under. nearest: the column with the object in view, if the place is that of the
    nearest one; then values within ceil(2 sigma) + 1 rows of a change of the object are NULL, as those are jumps and not motion.
    """
    rows = side.na.fill(0.0, ["lat", "vert", "dist", "presence"])
    rows = smoothed(rows, by, pos, {"__lat": "lat", "__vert": "vert", "__dist": "dist"}, sigma, "even", "nearest")
    made = {"__lat": "d_lat", "__vert": "d_vert", "__dist": "d_dist"}
    if size is not None:
        rows = rows.withColumn("__ang", angular_size(size, F.col("__dist"), 1e-6))
        made["__ang"] = "d_ang_size"
    for value, out in made.items():
        rows = gradient(rows, by, pos, value, out, time)
    turn = F.atan2("d_vert", "d_lat")
    rows = rows.withColumns({"motion_mag": F.sqrt(F.col("d_lat") * F.col("d_lat") + F.col("d_vert") * F.col("d_vert")), "motion_dir_sin": F.sin(turn), "motion_dir_cos": F.cos(turn)})
    names = [*made.values(), "motion_mag", "motion_dir_sin", "motion_dir_cos"]
    rows = rows.withColumns({c: F.when(F.col("presence") > 0, F.col(c)).otherwise(0.0) for c in names})
    if nearest:
        reach = math.ceil(2 * sigma) + 1 if sigma else 1
        change = lambda w: ((F.lag(nearest).over(w) != F.col(nearest)) & (F.col("presence") > 0) & (F.lag("presence").over(w) > 0)).cast("int")
        rows = windowed(rows, by, pos, {"__swap": change}, 1, 0)
        rows = windowed(rows, by, pos, {"__near": lambda w: F.max(F.coalesce("__swap", F.lit(0))).over(w.rowsBetween(-reach, reach))}, reach, reach)
        rows = rows.withColumns({c: F.when(F.col("__near") == 0, F.col(c)) for c in names})
    return rows.select(*by, pos, time, *names)


def component_slopes(scored: DataFrame, by: list[str], pos: str, time: str, vector: str, k: int, sigma: float = 2.0) -> DataFrame:
    """(by, pos, time, vector): the gradient per second of each smoothed component, place by place; NULL places where it isn't finite."""
    wide = scored.select(*by, pos, time, *[F.get(vector, i).alias(f"__c{i}") for i in range(k)])
    wide = smoothed(wide, by, pos, {f"__s{i}": f"__c{i}" for i in range(k)}, sigma, "even", "nearest")
    for i in range(k):
        wide = gradient(wide, by, pos, f"__s{i}", f"__g{i}", time)
    return wide.select(*by, pos, time, F.array(*[finite(f"__g{i}") for i in range(k)]).alias(vector))


def on_clock(rows: DataFrame, frames: DataFrame, by: list[str], time: str, at: str, steps: list[str], lines: list[str], bucket: float | None = None, ties: list[str] | None = None) -> DataFrame:
    """The frames with ``steps`` from the nearest sample and ``lines`` interpolated; ends are held. ties: the order of samples of one time."""
    out = interpolated(frames, rows, by, at, time, steps, "nearest", "clamp", bucket, ties) if steps else frames
    return interpolated(out, rows, by, at, time, lines, "linear", "clamp", bucket, ties) if lines else out


def feature_blocks(views: dict[str, DataFrame], beh: DataFrame, frames: DataFrame, by: list[str], pos: str, time: str, at: str, size: float, clip: float, mode: str = "angular", collapse: str = "salience_mean", pictures: DataFrame | None = None, n_pix: int = 20, pix_slopes: float | None = None, motion: float | None = None, objects: list[int] | None = None, self_moving: float | None = None, counts: list[str] | None = None, count_sigma: float = 0.0, bucket: float | None = None) -> dict[str, DataFrame]:
    """name -> (frames' columns, the block's columns): blocks agg and, as asked for, pix, pix_mot, motion, per_obj, self_mot and beh.

    views: side -> (by, pos, obj_id, lat, vert, dist) of what its screen shows. beh: (by, pos, time[, x, z, heading][,
    counts]) on the behaviour's clock, frames: (by, at) on the other. pictures: (by, pos, v), for n_pix components; the
    floats are the smoothing of what they turn on. Slopes at rows of one time aren't finite, and are NULL in the blocks, as
    is what is read off between such a row and another; of rows of one time a frame has the last before and the first behind it.
    """
    key, clock = [*by, pos], beh.select(*by, pos, time)
    blocks: dict[str, DataFrame] = {}
    agg, slopes, per_obj = frames, frames, frames
    for tag in sorted(views):
        side = settled(joined(scene.side_features(views[tag], clock, key, size, clip, collapse, mode), clock, key))
        own = [c for c in side.columns if c not in (*key, time)]
        rest = [c for c in own if c != "presence"]
        met = on_clock(side, frames, by, time, at, ["presence"], rest, bucket, [pos])
        there = F.col("presence") > 0
        met = met.withColumns({c: F.when(there, F.col(c)) for c in rest})
        agg = _beside(agg, met, by, at, own, tag)
        if motion is not None:
            raw = side if "dist" in side.columns else joined(scene.side_features(views[tag], clock, key, size, clip, collapse, "raw"), clock, key)
            near = None
            if collapse == "nearest":
                raw, near = joined(raw, views[tag].groupBy(*key).agg(F.min_by("obj_id", F.struct("dist", "obj_id")).alias("__obj")), key), "__obj"
            moving = motion_features(raw, by, pos, time, size if mode.startswith("angular") else None, motion, near)
            names = [c for c in moving.columns if c not in (*key, time)]
            known = finite("motion_mag").isNotNull()  # infinite slopes would have a direction still
            moving = moving.withColumns({c: F.when(known, finite(c)) for c in names})
            seen = on_clock(side, frames, by, time, at, ["presence"], [], bucket, [pos]).select(*by, at, "presence")
            got = joined(on_clock(moving, frames, by, time, at, [], names, bucket, [pos]), seen, [*by, at])
            slopes = _beside(slopes, got.withColumns({c: F.when(F.col("presence") > 0, F.col(c)) for c in names}), by, at, names, tag)
        if objects:
            shown = views[tag].withColumn("presence", F.lit(1.0)).withColumn("ang_size", angular_size(size, F.col("dist")))
            values = ["presence", "lat", "vert", "ang_size" if mode.startswith("angular") else "dist"]
            wide = joined(scene.slots(shown, clock, key, objects, values), clock, key)
            steps, lines = [f"o{o}_presence" for o in objects], [f"o{o}_{v}" for o in objects for v in values[1:]]
            got = on_clock(wide, frames, by, time, at, steps, lines, bucket, [pos])
            got = got.withColumns({f"o{o}_{v}": F.when(F.col(f"o{o}_presence") > 0, F.col(f"o{o}_{v}")) for o in objects for v in values[1:]})
            per_obj = _beside(per_obj, got, by, at, [*steps, *lines], tag)
    blocks["agg"] = agg
    if motion is not None:
        blocks["motion"] = slopes
    if objects:
        blocks["per_obj"] = per_obj
    if pictures is not None:
        found = principal(pictures, "v", n_pix)
        scored = settled(joined(scores(pictures, "v", found, key, n_pix).withColumnRenamed("scores", "v"), clock, key))
        k = len(found.loadings)
        blocks["pix"] = read_off(scored, frames, by, time, at, "v", k, "linear", bucket, [pos])
        if pix_slopes is not None:
            turning = read_off(component_slopes(scored, by, pos, time, "v", k, pix_slopes), frames, by, time, at, "v", k, "linear", bucket, [pos])
            blocks["pix_mot"] = turning.withColumn("v", F.when(~F.exists("v", lambda x: x.isNull()), F.col("v")))
    if self_moving is not None:
        moved = self_motion(beh, by, pos, self_moving).select(*key, time, "speed", "yaw_rate")
        blocks["self_mot"] = on_clock(moved, frames, by, time, at, [], ["speed", "yaw_rate"], bucket, [pos])
    if counts:
        blocks["beh"] = on_clock(event_features(beh.select(*key, time, *counts), by, pos, counts, count_sigma), frames, by, time, at, counts, [], bucket, [pos])
    return blocks


def _beside(left: DataFrame, right: DataFrame, by: list[str], at: str, names: list[str], tag: str) -> DataFrame:
    """Frames with the named columns of ``right``, the side's tag behind each name."""
    return joined(left, right.select(*by, at, *[F.col(c).alias(f"{c}_{tag}") for c in names]).dropDuplicates([*by, at]), [*by, at])


def trial_components(df: DataFrame, anchors: DataFrame, by: list[str], pos: str, vector: str, before: int, after: int, k: int) -> tuple[Components, DataFrame]:
    """Components of the rows of all trials' windows, one after another, and (by, anchor, rel, scores) of each row."""
    rows = settled(triggered(df.select(*by, pos, vector), anchors, by, pos, before, after))
    found = principal(rows, vector, k)
    return found, scores(rows, vector, found, [*by, "anchor", "rel"], k)


def tuned(trials: DataFrame, cell: str, kind: str, trial: str, rel: str, value: str, kinds: list, window: tuple[int, int], draws: int = 2000, share: float = 0.99865, size: int = 3, seed: int = 0) -> DataFrame:
    """(cell, kind, at, peak, threshold, tuned): where and how high each mean response of a kind of trial peaks, and whether that is above what means of random trials reach, within the window.

    trials: (cell, kind, trial, rel, value), trial a number and rel dense from 0. A draw takes, for each cell, as many
    trials as the kinds have on average, with replacement, by hash. The threshold is the draws' quantile at ``share``.
    """
    rows = trials.where(F.col(kind).isin(kinds))
    means = rows.groupBy(cell, kind, rel).agg(F.avg(value).alias("__m"))
    found = peak(means, [cell, kind], rel, "__m", size)
    index = rows.select(cell, kind, trial).distinct()
    from tracegrid.operators.ordered import positions

    index = settled(positions(index, [cell], trial, [kind], "__i"))
    n = index.groupBy(cell).agg(F.count("*").alias("__n"), F.countDistinct(kind).alias("__k"))
    asked = n.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__j", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.bround(F.col("__n") / F.lit(len(kinds))).cast("int")))))
    asked = asked.withColumn("__i", F.pmod(F.xxhash64(F.lit(seed), cell, "draw", "__j"), F.col("__n"))).select(cell, "draw", "__i")
    taken = joined(asked, index, [cell, "__i"], "inner").groupBy(cell, "draw", kind, trial).agg(F.count("*").alias("__w"))
    null = joined(taken, rows.select(cell, kind, trial, rel, value), [cell, kind, trial], "inner").groupBy(cell, "draw", rel).agg((F.sum(F.col(value) * F.col("__w")) / F.sum("__w")).alias("__m"))
    cut = quantiles(peak(null, [cell, "draw"], rel, "__m", size), [cell], "peak", [share]).select(cell, F.col("q").alias("threshold"))
    out = joined(found, cut, [cell])
    return out.select(cell, kind, "at", "peak", "threshold", ((F.col("peak") > F.col("threshold")) & F.col("at").between(*window)).alias("tuned"))


def shuffled_thresholds(df: DataFrame, cell: str, pos: str, value: str, cells: list, n: int, k: int, draws: int = 50, percent: float = 95.0, method: str = "nmf", rounds: int = 15, seed: int = 0) -> DataFrame:
    """(of, low, high): the cut for loadings and for scores, the same for all components, from factors of data whose cells are moved round by shifts of their own.

    Each draw's rows are normalised by cell; the draws share every pass. nmf gives an upper cut alone, pca both tails.
    """
    stats = df.groupBy(cell).agg(F.avg(value).alias("__a"), F.stddev_pop(value).alias("__s"))
    z = joined(df, stats, [cell]).select(cell, pos, F.coalesce(F.try_divide(F.col(value) - F.col("__a"), F.col("__s")), F.lit(0.0)).alias("__z"))
    low = z.agg(F.min("__z")).collect()[0][0] or 0.0
    moved = z.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(pos, F.pmod(F.col(pos) + F.pmod(F.xxhash64(F.lit(seed), "draw", cell), F.lit(n)), F.lit(n)))
    lift = float(low) if method == "nmf" else 0.0
    cols = [F.coalesce(F.max(F.when(F.col(cell) == c, F.col("__z"))), F.lit(0.0)) - lift for c in cells]
    wide = settled(moved.groupBy("draw", pos).agg(F.array(*cols).cast("array<double>").alias("v")))
    if method == "nmf":
        rng = np.random.default_rng(seed)
        fits = {d: start(np.full(len(cells), -lift), k, int(rng.integers(1 << 31))) for d in range(draws)}
        hs = {d: f.h for d, f in non_negative(wide.withColumn("g", F.array(F.col("draw").cast("bigint"))), "v", fits, "g", rounds=rounds, inner=20).items()}
        weigh = lambda x, h: row_weights(np.maximum(x, 0), h, inner=20)
    elif method == "pca":
        found = moments(wide, "v", "draw")
        hs = {d: np.linalg.eigh(m.scatter)[1][:, ::-1][:, :k].T for d, m in found.items()}
        weigh = lambda x, h: x @ h.T
    else:
        raise ValueError(f"unknown method {method!r}")

    def scored(v, keys):
        out = np.zeros((len(v), k))
        for d in np.unique(keys["draw"]):
            mine = keys["draw"] == d
            out[mine] = weigh(v[mine], hs[int(d)])
        return {"s": out}

    tails = [percent / 100] if method == "nmf" else [(100 - percent) / 200, 1 - (100 - percent) / 200]
    long = mapped(wide, "v", {"s": "array<double>"}, scored, ["draw"]).select(F.explode("s").alias("x"))
    got = {round(r["p"], 9): r["q"] for r in quantiles(long, [], "x", tails).collect()}
    pool = np.concatenate([h.reshape(-1) for h in hs.values()])  # draws x k x cells
    rows = [("loadings", *np.percentile(pool, [100 * t for t in tails])), ("scores", *[got[round(t, 9)] for t in tails])]
    return df.sparkSession.createDataFrame([(r[0], None if len(r) == 2 else float(r[1]), float(r[-1])) for r in rows], "of string, low double, high double")


def window_frames(seconds: tuple[float, float], rate: float) -> tuple[list[int], list[float]]:
    """Frames before and after an event for a window in seconds, both rounded up, and their times to four decimals."""
    ends = [math.ceil(abs(seconds[0]) * rate), math.ceil(seconds[1] * rate)]
    return ends, [round(k / rate, 4) for k in range(-ends[0], ends[1])]


def from_projections(df: DataFrame, channels: list[str], directions: list[list[float]], out: tuple[str, str, str] = ("ax", "ay", "az")) -> DataFrame:
    """Add the three-vector that makes the channels its projections on the directions, by least squares; NULL channels count as 0."""
    back = np.linalg.pinv(np.array(directions, dtype=np.float64))
    return df.withColumns({name: sum((float(w) * F.coalesce(F.col(c), F.lit(0.0)) for w, c in zip(row, channels, strict=True)), F.lit(0.0)) for name, row in zip(out, back, strict=True)})


def sensor_directions(theta: float = 140.0, phis: tuple[float, float] = (0.0, -90.0)) -> list[list[float]]:
    """The four directions, in degrees, that two sensors at ``theta`` from the vertical read a turn along: across and along each."""
    s, c = lambda a: math.sin(math.radians(a)), lambda a: math.cos(math.radians(a))
    out = []
    for phi in phis:
        out += [[c(phi - 90), s(phi - 90), 0.0], [s(theta + 90) * c(phi), s(theta + 90) * s(phi), c(theta + 90)]]
    return out


def vertices_in_view(objects: DataFrame, shapes: DataFrame, phi: float, theta: float, opening: float, kind: str = "kind") -> DataFrame:
    """(obj_id, vertex, u, v): the objects' vertices within half the opening left and right of the view, on the tangent plane.

    objects: (obj_id, kind, x, y, z) as seen from the eye; shapes: (kind, vertex, x, y, z). v is the tangent of the angle below.
    """
    from tracegrid.functions.columns import spherical, wrapped

    parts = shapes.select(F.col(kind).alias("__kind"), "vertex", *[F.col(c).alias(f"__{c}") for c in "xyz"])
    met = objects.join(parts, F.col(kind) == F.col("__kind"))
    _, down, side = spherical(*[F.col(c) + F.col(f"__{c}") for c in "xyz"])
    met = met.withColumns({"__p": wrapped(side - phi), "__t": wrapped(down - theta)})
    return met.where(F.abs("__p") < opening / 2).select("obj_id", "vertex", F.tan("__p").alias("u"), F.tan("__t").alias("v"))


def corners(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, corner, x, y, centre_x, centre_y) of corner lists written as JSON, [[x, y], ...]; what isn't such a list has no row."""
    rows = df.select(*key, F.posexplode(F.from_json(text, "array<array<double>>")).alias("corner", "__p")).where(F.size("__p") >= 2)
    rows = rows.select(*key, "corner", F.get("__p", 0).alias("x"), F.get("__p", 1).alias("y"))
    return joined(rows, rows.groupBy(*key).agg(F.avg("x").alias("centre_x"), F.avg("y").alias("centre_y")), key)


def settings(spark, **values) -> DataFrame:
    """Every combination of the settings, a column each, the last one changing fastest: a small table by nature."""
    return spark.createDataFrame(list(product(*values.values())), list(values))


def first_flag(stimuli: Column) -> Column:
    """Whether a frame was shown: the first entry of its stimulus list, as a truth value; NULL lists weren't."""
    return F.coalesce(F.get(stimuli, 0) != 0, F.lit(False))
