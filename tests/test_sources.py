"""Readers of session files."""

from tracegrid.operators import trials
from tracegrid.sources import objects, sessions


def test_frame_metadata(spark, tmp_path):
    (tmp_path / "m1_frames.xml").write_text('<PVScan><Sequence><Frame relativeTime="0.0" absoluteTime="1.5" index="1"><File channel="2" page="1"/></Frame><Frame relativeTime="0.1" absoluteTime="1.6" index="2"/></Sequence></PVScan>')
    rows = sessions.frame_times(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["session"], r["index"], r["relativeTimes"], r["channel"], r["page"]) for r in rows] == [("m1_frames", 1, 0.0, "2", 1), ("m1_frames", 2, 0.1, None, None)]


WORLD = """<world><meshVertList><vert index="0"><x>1.5</x><y>2</y><z>-3</z></vert><vert index="a1"><x>0</x><y>0</y><z>4.25</z></vert></meshVertList>
<objList><obj index="7"><x>1</x><y>2</y><z>3</z><type>1</type></obj></objList>
<objTypeList><objType index="0"><vertList><vert index="0"><x>1</x><y>1</y><z>1</z></vert></vertList></objType><objType index="1"><vertList><vert index="0"><x>5</x><y>6</y><z>7</z></vert><vert index="1"><x>8</x><y>9</y><z>10</z></vert></vertList></objType></objTypeList></world>"""


def test_nested_meshes(spark, tmp_path):
    (tmp_path / "m1.xml").write_text(WORLD)
    (tmp_path / "m2.xml").write_text("<world><objList/></world>")
    folder = str(tmp_path)
    assert sorted(map(tuple, objects.mesh(spark, folder).collect())) == [("m1", "0", 1.5, 2.0, -3.0), ("m1", "a1", 0.0, 0.0, 4.25)]
    assert [tuple(r) for r in objects.objects(spark, folder).collect()] == [("m1", "7", 1.0, 2.0, 3.0, 1.0)]
    assert sorted(map(tuple, objects.object_types(spark, folder).collect())) == [("m1", "0", "0", 1.0, 1.0, 1.0), ("m1", "1", "0", 5.0, 6.0, 7.0), ("m1", "1", "1", 8.0, 9.0, 10.0)]


def test_sessions_and_films_in_order(spark, tmp_path):
    for name in ("b_2024_2_1_3h_4m_Events.csv", "b_2024_2_1_3h_4m_Movement.csv", "a_2024_3_1_0h_0m_Events.csv", "undated_Events.csv", "z.MP4", "y.avi", "x.txt"):
        (tmp_path / name).write_text("x")
    found = sorted(objects.sessions_in_order(spark, str(tmp_path), [".csv"]).collect(), key=lambda r: r["place"])
    assert [r["session"] for r in found] == ["b_2024_2_1_3h_4m", "a_2024_3_1_0h_0m", "undated"] and found[2]["started"] is None
    assert [(r["name"], r["place"]) for r in objects.videos(spark, str(tmp_path)).orderBy("place").collect()] == [("y.avi", 0), ("z.MP4", 1)]


def test_frames_are_saved_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5)], "index bigint, relativeTimes double")
    for n in (1, 2):
        objects.save_frames(rows.withColumn("n", rows["index"] * n), str(tmp_path / "out"))
    assert [r["n"] for r in spark.read.option("header", "true").csv(str(tmp_path / "out")).collect()] == ["1"]


def test_scattered_series(spark):
    values = spark.createDataFrame([("a", k, 10.0 + k) for k in range(5)], "s string, k bigint, v double")
    cuts = spark.createDataFrame([("a", 7, 8), ("a", 2, 4)], "s string, start int, end int")
    rows = sorted((r["frame"], r["v"]) for r in objects.scattered(values, cuts, ["s"], "k", "v").collect())
    assert rows == [(0, 0.0), (1, 10.0), (2, 11.0), (3, 12.0), (4, 0.0), (5, 0.0), (6, 13.0), (7, 14.0)]


def test_catalogue_and_present_values(spark):
    sheet = spark.createDataFrame([(0, "m1", 1), (1, "m2", 1), (2, "m1", 0), (3, "m1", 1)], "row bigint, mouse string, run int")
    assert [(r["mouse"], r["row"]) for r in objects.catalogue(sheet, mouse="m1", run=1).orderBy("row").collect()] == [("m1", 0), ("m1", 1)]
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, 6), ("b", 1, None)], "g string, k bigint, v int")
    assert sorted(map(tuple, objects.present(rows, ["g"], "k", "v").collect())) == [("a", 0, 5), ("a", 1, 6)]


def test_block_of_targets(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(50)], "k bigint, x double")
    flat = trials.target_block(df, ["k"], "k", "agg", ["x"], {"agg": 0.1}, None, 30.0)
    assert abs(flat.where("k = 25").first()["x"]) < 1e-9
    assert trials.target_block(df, ["k"], "k", "pix", ["x"], {"agg": 0.1}, None, 30.0).where("k = 25").first()["x"] == 25.0
    assert trials.first_of(df, [], "k", 3).count() == 3
