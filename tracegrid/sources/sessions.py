"""Recorded sessions: finding their files, and reading tables, parameters and XML into typed rows with a ``session``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrid.operators.ordered import joined, positions, windowed

SCHEMAS = {
    "MovementData": "Time double, x_pos double, y_pos double, z_pos double, x_rot_eu double, y_rot_eu double, totalDist double",
    "Events": "Time double, event string",
    "ObjectData": "ObjLocX double, ObjLocY double, ObjLocZ double",
    "ObjectEvents": "ObjLocX double, ObjLocY double, ObjLocZ double, Time double",
    "Terrain4Data": "ChunkPosX double, ChunkPosZ double, x int, z int, height double",
}


def files(spark: SparkSession, folder: str, endings: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """(path, name, bytes, modified): any of the endings, all of the tags; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    if endings:
        test = F.lit(False)
        for e in endings:
            test = test | F.col("name").endswith(e)
        found = found.where(test)
    for t in tags or []:
        found = found.where(F.col("name").contains(t))
    return found


def session_of(path: Column) -> Column:
    """What stands before the table's name in {session}_{table}.csv."""
    return F.regexp_extract(path, r"([^/]+)_[A-Za-z0-9]+\.[a-z]+$", 1)


def started(session: Column) -> Column:
    """Timestamp of tags that end in Y_M_D_Hh_Mm."""
    p = lambda k: F.regexp_extract(session, r"(\d{4})_(\d+)_(\d+)_(\d+)h_(\d+)m", k).try_cast("int")
    return F.when(p(5).isNotNull(), F.make_timestamp_ntz(p(1), p(2), p(3), p(4), p(5), F.lit(0)))


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """All sessions' rows of one table, with ``session`` and ``row``, the place in its file."""
    read = spark.read.schema(schema or SCHEMAS[name]).option("header", "true").option("enforceSchema", "false").option("pathGlobFilter", f"*_{name}.csv").csv(folder)
    # A file's splits are told apart by where they start, and within one the id grows along the file.
    start = F.col("_metadata.file_block_start")
    read = read.withColumns({"session": session_of(F.col("_metadata.file_path")), "__block": start, "__at": F.monotonically_increasing_id()})
    sizes = read.groupBy("session", "__block").agg(F.count("*").alias("__n"))
    over = Window.partitionBy("session").orderBy("__block")  # a row for each split of a file
    before = sizes.select("session", "__block", (F.sum("__n").over(over) - F.col("__n")).alias("__before"))
    row = F.row_number().over(Window.partitionBy("session", "__block").orderBy("__at")) - 1
    return joined(read.withColumn("__row", row), before, ["session", "__block"]).withColumn("row", (F.col("__row") + F.col("__before")).cast("int")).drop("__block", "__at", "__row", "__before")


def parameters(spark: SparkSession, folder: str, sheet: DataFrame | None = None) -> DataFrame:
    """(session, zone, zonal, lick_reward, least_dist): JSON first, then the sheet, then 0. Zones over 100 were squared."""
    names = {"zone": ("objectRewardZoneDistance", "zoneDist"), "zonal": ("rewardZonesOn", "zonal"), "lick_reward": ("lickRewardOn", "lickReward"), "least_dist": ("minRewardDistace", "minDist")}
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*_params.json").text(folder).withColumn("session", session_of(F.col("_metadata.file_path")))
    fields = F.from_json("value", ", ".join(f"{j} double" for j, _ in names.values()))
    own = raw.select("session", *[fields[j].alias(k) for k, (j, _) in names.items()])
    if sheet is not None:
        own = own.join(sheet.select(F.col("dateTags").alias("session"), *[F.col(s).cast("double").alias(f"__{k}") for k, (_, s) in names.items()]), "session", "full_outer")
        own = own.select("session", *[F.coalesce(F.nanvl(k, F.lit(None)), F.nanvl(f"__{k}", F.lit(None)), F.lit(0.0)).alias(k) for k in names])
    own = own.na.fill(0.0)
    return own.withColumn("zone", F.when(F.col("zone") > 100, F.sqrt("zone")).otherwise(F.col("zone")))


def frame_times(spark: SparkSession, path: str) -> DataFrame:
    """(index, relativeTimes, absoluteTimes, channel, page, session) of frame metadata in XML; session is the file's name without its ending."""
    raw = spark.read.format("xml").option("rowTag", "Frame").schema("_index bigint, _relativeTime double, _absoluteTime double, File array<struct<_channel:string,_page:int>>").load(path)
    return raw.select(F.col("_index").alias("index"), F.col("_relativeTime").alias("relativeTimes"), F.col("_absoluteTime").alias("absoluteTimes"), F.get("File", 0)["_channel"].alias("channel"), F.get("File", 0)["_page"].alias("page"), F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("session"))


def good_components(df: DataFrame, r: float = 0.5, snr: float = 1.5, cnn: float = 0.8) -> DataFrame:
    """Components that pass all quality limits; NULL fails."""
    return df.where((F.col("r_values") >= r) & (F.col("snr") > snr) & (F.col("cnn") >= cnn))


def first_value(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, value): that of the first row; NULL and NaN as 0."""
    return df.groupBy(*by).agg(F.coalesce(F.nanvl(F.min_by(F.col(value).cast("double"), order), F.lit(None)), F.lit(0.0)).alias(value))


def pulse_delay(events: DataFrame, by: list[str], time: str, is_pulse: Column, first_frame: DataFrame | None = None) -> DataFrame:
    """(by, first_pulse, max_gap, n_pulses[, delay]): delay is the first pulse minus the session's first frame time."""
    rows = windowed(positions(events.where(is_pulse), by, time, [], "__pos"), by, "__pos", {"__gap": lambda w: F.col(time) - F.lag(time).over(w)}, 1, 0)
    out = rows.groupBy(*by).agg(F.min(time).alias("first_pulse"), F.max("__gap").alias("max_gap"), F.count("*").alias("n_pulses"))
    if first_frame is not None:
        out = joined(out, first_frame, by).withColumn("delay", F.col("first_pulse") - F.col("frame_time")).drop("frame_time")
    return out
