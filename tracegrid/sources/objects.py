"""Meshes and objects from nested XML, catalogues, and what records have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.operators.ordered import joined, positions
from tracegrid.sources.sessions import files, session_of, started

_PLACE = "_index string, x double, y double, z double"


def _file():
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[a-z]+$", 1)


def mesh(spark: SparkSession, path: str, root: str = "world") -> DataFrame:
    """(file, index, x, y, z) of the mesh's vertices; an index stays a text. root: the files' outermost tag."""
    raw = spark.read.format("xml").option("rowTag", root).schema(f"meshVertList struct<vert: array<struct<{_PLACE}>>>").load(path)
    return raw.select(_file().alias("file"), F.explode("meshVertList.vert").alias("v")).select("file", F.col("v._index").alias("index"), "v.x", "v.y", "v.z")


def objects(spark: SparkSession, path: str, root: str = "world") -> DataFrame:
    """(file, index, x, y, z, type) of the objects."""
    raw = spark.read.format("xml").option("rowTag", root).schema(f"objList struct<obj: array<struct<{_PLACE}, type double>>>").load(path)
    return raw.select(_file().alias("file"), F.explode("objList.obj").alias("o")).select("file", F.col("o._index").alias("index"), "o.x", "o.y", "o.z", "o.type")


def object_types(spark: SparkSession, path: str, root: str = "world") -> DataFrame:
    """(file, type, index, x, y, z): the vertices of each type of object."""
    raw = spark.read.format("xml").option("rowTag", root).schema(f"objTypeList struct<objType: array<struct<_index string, vertList struct<vert: array<struct<{_PLACE}>>>>>>").load(path)
    rows = raw.select(_file().alias("file"), F.explode("objTypeList.objType").alias("t")).select("file", F.col("t._index").alias("type"), F.explode("t.vertList.vert").alias("v"))
    return rows.select("file", "type", F.col("v._index").alias("index"), "v.x", "v.y", "v.z")


def catalogue(sheet: DataFrame, **wanted) -> DataFrame:
    """Rows of a catalogue whose columns have the wanted values, with ``row``, their new place in the order of the old one (``row`` or the first column)."""
    rows = sheet
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value)
    order = "row" if "row" in sheet.columns else sheet.columns[0]
    return positions(rows.withColumnRenamed("row", "__old") if order == "row" else rows, [], "__old" if order == "row" else order, [], "row").drop("__old")


def present(df: DataFrame, by: list[str], order: str, value: str, width: float | None = None) -> DataFrame:
    """(by, place, value): the values that are there, numbered in order; records without one are passed over."""
    return positions(df.where(F.col(value).isNotNull()), by, order, [], "place", width).select(*by, "place", value)


def sessions_in_order(spark: SparkSession, folder: str, endings: list[str] | None = None) -> DataFrame:
    """(session, started, place): each session of the folder's files once, by when it started, then by name; undated ones come last."""
    found = files(spark, folder, endings).select(session_of(F.col("name")).alias("session")).where("session <> ''").distinct()
    rows = found.withColumn("started", started(F.col("session")))
    rows = rows.withColumn("__key", F.coalesce(F.col("started").cast("timestamp").cast("double"), F.lit(float("inf"))))
    return positions(rows, [], "__key", ["session"], "place").drop("__key")


def videos(spark: SparkSession, folder: str, endings: tuple[str, ...] = (".avi", ".mp4", ".mov", ".mkv")) -> DataFrame:
    """(path, name, place) of films by path, whatever the case of their ending."""
    found = files(spark, folder).where(F.lower(F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1)).isin(*endings)).select("path", "name")
    return positions(found, [], "path", [], "place")


def scattered(values: DataFrame, cuts: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """(by, frame, value): a series that was recorded in cuts, on the whole timeline, with 0 in the gaps.

    values: (by, pos, value), positions dense over all cuts together. cuts: (by, start, end), frames from 1, both ends
    included, in order of start. Each frame is a row.
    """
    spans = positions(cuts, by, "start", [], "__cut")
    from pyspark.sql import Window

    length = F.col("end") - F.col("start") + 1
    over = Window.partitionBy(*by).orderBy("__cut")  # a row for each cut
    spans = spans.withColumns({"__from": F.sum(length).over(over) - length, "__last": F.max("end").over(Window.partitionBy(*by)), "__next": F.lead("start").over(over)})
    kept = spans.select(*by, F.posexplode(F.sequence(F.col("start") - 1, F.col("end") - 1)).alias("__k", "frame"), "__from").select(*by, "frame", (F.col("__from") + F.col("__k")).cast("bigint").alias(pos))
    full = joined(kept, values.select(*by, pos, value), [*by, pos]).select(*by, "frame", F.coalesce(F.col(value), F.lit(0.0)).alias(value))
    first = F.when(F.col("__cut") == 0, F.lit(1))
    holes = spans.select(*by, F.explode(F.array(F.struct(first.alias("a"), (F.col("start") - 1).alias("b")), F.struct((F.col("end") + 1).alias("a"), (F.col("__next") - 1).alias("b")))).alias("h")).where("h.a <= h.b")
    return full.unionByName(holes.select(*by, F.explode(F.sequence(F.col("h.a") - 1, F.col("h.b") - 1)).alias("frame")).withColumn(value, F.lit(0.0)))


def save_frames(frames: DataFrame, path: str) -> None:
    """Frame metadata as CSV with a header, unless it is there already."""
    frames.write.mode("ignore").option("header", "true").csv(path)
