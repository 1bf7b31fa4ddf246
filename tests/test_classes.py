"""Objects at one place are looked at once, and count as many."""

import pytest
from pyspark.sql import functions as F

from tracegrid.operators import raster, scene
from tracegrid.plans.scenes import MONITOR, SIZE

KEY = ["event_id"]


def rounded(df):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())


@pytest.fixture(scope="module")
def parts(spark):
    frames = spark.range(12).select(F.col("id").alias("event_id"), F.col("id").cast("double").alias("t"), (F.col("id") * 2.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    k = F.col("id")
    objects = spark.range(200).select(k.alias("obj_id"), (k % 4 * 5.0).alias("x"), F.lit(1.0).alias("y"), (k % 2 * 3.0 + 4).alias("z"), F.when(k % 3 == 0, F.lit(6.0)).alias("gone"))
    objects = objects.unionByName(objects.where("obj_id in (5, 6, 7)")).unionByName(objects.where("obj_id = 8").withColumn("x", F.lit(9.0)))
    return frames, objects, *scene.classed(objects, [], [9])


def test_classes_see_what_their_members_see(parts):
    frames, objects, sites, members = parts
    whole, few = scene.in_view(frames, objects, [], MONITOR), scene.in_view(frames, sites, [], MONITOR)
    assert few.count() < 20 * frames.count() < whole.count()
    assert {r["member"] for r in members.where("obj_id = 9").collect()} == {9}
    cols = ["event_id", "obj_id", "dist", "lat", "vert"]
    assert rounded(scene.expanded(few, members, []).select(*cols)) == rounded(whole.select(*cols))
    slots = scene.expanded(scene.slot_rows(few, frames, KEY, ["lat", "dist"]), members, [], "left").select("event_id", "obj_id", "lat", "dist")
    assert rounded(slots) == rounded(scene.slot_rows(whole, frames, KEY, ["lat", "dist"]).select("event_id", "obj_id", "lat", "dist"))


def test_classes_count_as_many(parts):
    frames, objects, sites, _ = parts
    whole, few = scene.in_view(frames, objects, [], MONITOR), scene.in_view(frames, sites, [], MONITOR)
    for collapse in ("nearest", "salience_mean"):
        one, two = (scene.side_features(v, frames, KEY, SIZE, MONITOR.clip, collapse) for v in (whole, few))
        assert rounded(one) == rounded(two.select(one.columns))
    assert rounded(raster.silhouettes(whole, KEY, MONITOR, 9, 9, SIZE, 2.0, 0.5, raw=True)) == rounded(raster.silhouettes(few, KEY, MONITOR, 9, 9, SIZE, 2.0, 0.5, raw=True))
