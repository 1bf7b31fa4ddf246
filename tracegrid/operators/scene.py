"""What is in view: frames against objects, features of what each side sees, and the look-up of terrain heights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.columns import angular_size, salience, spherical, wrapped
from tracegrid.operators.ordered import joined
from tracegrid.operators.settle import settled


@dataclass(frozen=True)
class Monitor:
    """Direction of a screen's centre, its openings in radians, and how far it shows."""

    phi: float
    theta: float
    h_fov: float
    v_fov: float
    clip: float


def rewarded_at(objects: DataFrame, events: DataFrame, by: list[str], time: str) -> DataFrame:
    """Objects with ``gone``: time of the first event at exactly their place, else NULL."""
    place = ["x", "y", "z"]
    first = events.groupBy(*by, *place).agg(F.min(time).alias("gone"))
    return joined(objects, first, [*by, *place])


def classed(objects: DataFrame, by: list[str], apart: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Objects that share their places and what ends them are one class: a frame sees all of a class or none.

    (objects with ``n``, the size of a class; (by, obj_id, member)). A class is named by its least obj_id, and those listed
    in ``apart`` have one of their own. Work on the classes grows with the different places and not with the objects.
    """
    alone = F.when(F.col("obj_id").isin(apart), F.col("obj_id")) if apart else F.lit(None).cast("bigint")
    of = objects.groupBy(*by, "obj_id").agg(F.array_sort(F.collect_list(F.struct("x", "y", "z", "gone"))).alias("__sites")).withColumn("__alone", alone)
    found = settled(of.groupBy(*by, "__sites", "__alone").agg(F.min("obj_id").alias("__rep"), F.count("*").alias("n")))
    sites = found.select(*by, F.col("__rep").alias("obj_id"), "n", F.inline("__sites"))
    members = joined(of, found, [*by, "__sites", "__alone"], "inner").select(*by, F.col("__rep").alias("obj_id"), F.col("obj_id").alias("member"))
    return sites, members


def expanded(rows: DataFrame, members: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Rows of classes as rows of each of their objects."""
    return joined(rows, members, [*by, "obj_id"], how).withColumn("obj_id", F.col("member")).drop("member", "n")


def in_view(frames: DataFrame, objects: DataFrame, by: list[str], monitor: Monitor, time: str = "t") -> DataFrame:
    """(frame columns, obj_id, dist, lat, vert) of each object that a frame shows, and ``n`` if the objects have it.

    frames: x, y, z; objects: obj_id, x, y, z, gone. Only pairs in reach meet: floor squares as wide as the clipping
    distance are joined to the 3 x 3 around them, and objects are the side that is copied.
    """
    clip = float(monitor.clip)
    square = lambda c, d=0: F.floor(F.col(c) / clip).cast("bigint") + d
    size = ["n"] if "n" in objects.columns else []
    near = objects.select(*[F.col(b).alias(f"__o_{b}") for b in by], "obj_id", *size, *[F.col(c).alias(f"o{c}") for c in "xyz"], "gone")
    near = near.withColumn("__dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("__dz", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = near.withColumns({"__sx": square("ox") + F.col("__dx"), "__sz": square("oz") + F.col("__dz")}).drop("__dx", "__dz")
    on = [F.col(b).eqNullSafe(F.col(f"__o_{b}")) for b in by] + [F.col("__fx") == F.col("__sx"), F.col("__fz") == F.col("__sz")]
    met = frames.withColumns({"__fx": square("x"), "__fz": square("z")}).join(near, on)
    rho, theta, phi = spherical(F.col("ox") - F.col("x"), F.col("oy") - F.col("y"), F.col("oz") - F.col("z"))
    met = met.withColumns({"dist": rho, "lat": wrapped(F.lit(float(monitor.phi)) - phi), "vert": wrapped(F.lit(float(monitor.theta)) - theta)})
    seen = (F.col("dist") < clip) & (F.abs("lat") < monitor.h_fov / 2) & (F.abs("vert") < monitor.v_fov / 2) & F.coalesce(F.col(time) < F.col("gone"), F.lit(True))
    return met.where(seen).select(*frames.columns, "obj_id", *size, "dist", "lat", "vert")


def side_features(view: DataFrame, frames: DataFrame, key: list[str], size: float, clip: float, collapse: str = "nearest", mode: str = "raw") -> DataFrame:
    """Every frame with presence, lat, vert and dist (or ang_size), and salience if the mode has it; 0 where nothing is seen.

    collapse: nearest (of equals the least obj_id) or salience_mean (weighted by angular size). A row counts ``n`` times if it has that.
    """
    if collapse == "nearest":
        seen = view.groupBy(*key).agg(F.min_by(F.struct("lat", "vert", "dist"), F.struct("dist", "obj_id")).alias("s")).select(*key, "s.*")
    elif collapse == "salience_mean":
        w = angular_size(size, F.col("dist"), 1e-6) * (F.col("n") if "n" in view.columns else 1)
        mean = lambda c: F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(c)
        seen = view.groupBy(*key).agg(*[mean(c) for c in ("lat", "vert", "dist")])
    else:
        raise ValueError(f"unknown collapse {collapse!r}")
    if mode not in ("raw", "angular", "salience", "angular_salience"):
        raise ValueError(f"unknown mode {mode!r}")
    made: dict[str, Column] = {"presence": F.lit(1.0)}
    if mode.endswith("salience"):
        made["salience"] = salience(F.col("dist"), clip)
    if mode.startswith("angular"):
        made["ang_size"] = angular_size(size, F.col("dist"))
    seen = seen.withColumns(made)
    if "ang_size" in made:
        seen = seen.drop("dist")
    return joined(frames.select(*key), seen, key).na.fill(0.0)


def slots(view: DataFrame, frames: DataFrame, key: list[str], objects: list[int], values: list[str]) -> DataFrame:
    """Every frame with columns o{id}_{value} for each object of a fixed list; 0 where it is not seen."""
    wide = view.groupBy(*key).agg(*[F.max(F.when(F.col("obj_id") == o, F.col(v))).alias(f"o{o}_{v}") for o in objects for v in values])
    return joined(frames.select(*key), wide, key).na.fill(0.0)


def slot_rows(view: DataFrame, frames: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, obj_id, values) of all objects that each frame shows, however many there are; one row without an object where it shows none."""
    seen = view.groupBy(*key, "obj_id").agg(*[F.max(v).alias(v) for v in values])
    return joined(frames.select(*key), seen, key)


def view_shares(view: DataFrame, frames: int, key: list[str]) -> DataFrame:
    """(one, two, most): share of frames with at least one and two objects, and the most at once."""
    n = view.groupBy(*key).agg(F.count("*").alias("n"))
    return n.agg((F.count("*") / frames).alias("one"), (F.count_if(F.col("n") >= 2) / frames).alias("two"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def near_frames(view: DataFrame, key: list[str], distance: float) -> DataFrame:
    """Frames that show something nearer than ``distance``; meant for a left semi join with each block."""
    return view.where(F.col("dist") < distance).select(*key).distinct()


def world(terrain: DataFrame, flip_x: bool = False, flip_z: bool = True, swap: bool = False, centred: bool = True, cell: float = 1.0) -> DataFrame:
    """Add world_x, world_z to terrain rows (chunk_x, chunk_z, x, z, height); the greatest index is read from the rows."""
    top = terrain.agg(F.max("x").alias("__mx"), F.max("z").alias("__mz"))
    rows = terrain.join(F.broadcast(top))  # one row
    ix = F.col("__mx") - F.col("x") if flip_x else F.col("x")
    iz = F.col("__mz") - F.col("z") if flip_z else F.col("z")
    off = lambda m: F.col(m) / 2 * cell if centred else F.lit(0.0)
    x, z = F.col("chunk_x") + ix * cell - off("__mx"), F.col("chunk_z") + iz * cell - off("__mz")
    return rows.withColumns({"world_x": z, "world_z": x} if swap else {"world_x": x, "world_z": z}).drop("__mx", "__mz")


def nearest_cells(points: DataFrame, cells: DataFrame, key: list[str], values: list[str], pitch: float = 1.0) -> DataFrame:
    """Points (x, z) with ``values`` of the nearest cell (x, z) and ``cell_dist``; of equals the least by (z, x).

    Cells are dealt to squares. A point looks in its own and the 8 around it, which holds the answer if that lies within
    one pitch; points that find none so near look again with squares twice as wide, until all have found one.
    """
    from tracegrid.operators.nearest import widening

    return widening(points, cells, key, values, pitch)


def bilinear(points: DataFrame, grid: DataFrame, key: list[str], value: str, nx: int, nz: int) -> DataFrame:
    """Points (key, x, z in cells) with ``value`` of a full grid (gx, gz), weighted by the four corners around; x and z are kept inside."""
    inside = lambda c, n: F.greatest(F.lit(0.0), F.least(F.col(c).cast("double"), F.lit(n - 1 - 1e-6)))
    p = points.withColumns({"__x": inside("x", nx), "__z": inside("z", nz)}).withColumns({"__fx": F.floor("__x"), "__fz": F.floor("__z")})
    tx, tz = F.col("__x") - F.col("__fx"), F.col("__z") - F.col("__fz")
    corner = lambda dx, dz: F.struct((F.col("__fx") + dx).alias("cx"), (F.col("__fz") + dz).alias("cz"), ((tx if dx else 1 - tx) * (tz if dz else 1 - tz)).alias("w"))
    asked = p.select(*key, F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select(*key, "c.*")
    met = asked.join(grid.select(F.col("gx").alias("cx"), F.col("gz").alias("cz"), F.col(value).alias("__v")), ["cx", "cz"])
    return met.groupBy(*key).agg(F.sum(F.col("w") * F.col("__v")).alias(value))


def delta_summary(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """(by, median, mean, std, p5, p95) of a difference of heights."""
    from tracegrid.operators.stats import quantiles

    q = quantiles(df, by, delta, [0.05, 0.5, 0.95])
    pick = lambda p, name: F.max(F.when(F.col("p") == p, F.col("q"))).alias(name)
    q = q.groupBy(*by).agg(pick(0.5, "median"), pick(0.05, "p5"), pick(0.95, "p95"))
    return joined(df.groupBy(*by).agg(F.avg(delta).alias("mean"), F.stddev_pop(delta).alias("std")), q, by)


def offset_sweep(points: DataFrame, cells: DataFrame, offsets: DataFrame, key: list[str], height: str, y: str, pitch: float = 1.0) -> DataFrame:
    """delta_summary of y minus the nearest cell's height for each offset (ox, oz) that is added to the points."""
    moved = points.join(F.broadcast(offsets)).withColumns({"x": F.col("x") + F.col("ox"), "z": F.col("z") + F.col("oz")})  # offsets: a small table of settings
    met = nearest_cells(moved, cells, [*key, "ox", "oz", y], [height], pitch).withColumn("delta", F.col(y) - F.col(height))
    return delta_summary(met, ["ox", "oz"], "delta")


def seam_rms(terrain: DataFrame, n: int = 3) -> DataFrame:
    """(edge_a, edge_b, rms): root mean square difference of heights, along z, of the last n columns of a chunk and the first n of the next one in x."""
    chunks = terrain.select("chunk_x").distinct()
    follows = chunks.join(chunks.select(F.col("chunk_x").alias("next_x")), F.col("next_x") > F.col("chunk_x")).groupBy("chunk_x").agg(F.min("next_x").alias("next_x"))
    last = terrain.agg(F.max("x").alias("__m"))
    a = terrain.join(F.broadcast(last)).where(F.col("x") > F.col("__m") - n).join(follows, "chunk_x").select("next_x", "chunk_z", "z", (F.col("__m") - F.col("x")).alias("edge_a"), F.col("height").alias("ha"))
    b = terrain.where(F.col("x") < n).select(F.col("chunk_x").alias("next_x"), "chunk_z", "z", F.col("x").alias("edge_b"), F.col("height").alias("hb"))
    return a.join(b, ["next_x", "chunk_z", "z"]).groupBy("edge_a", "edge_b").agg(F.sqrt(F.avg(F.pow(F.col("ha") - F.col("hb"), 2))).alias("rms"))
