import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import clouds
from cloudloom.sources import ply, points, sinks
from cloudloom.streaming import decimate as streaming
from tests.test_clouds import cloud, random_cloud

HEADER = "ply\nformat ascii 1.0\ncomment made for a test\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty float normal_x\nproperty float ny\nproperty float nz\nproperty uchar Red\nproperty uchar green\nproperty uchar blue\nend_header\n"
ROWS = "0 0 0 0 0 1 255 0 0\n0.1 0.1 0.1 0 0 1 0 255 0\n2 2 2 0 0 1 0 0 255\n5 5 5 0 1 0 9 9 9\n"


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_ascii_with_normals_and_colours(spark, tmp_path):
    df = ply.load(spark, write(tmp_path / "a.ply", HEADER + ROWS))
    got = df.orderBy("point_id").collect()
    assert len(got) == 4 and got[0]["red"] == 255 and got[3]["ny"] == 1.0
    assert ply.load(spark, write(tmp_path / "a.ply", HEADER + ROWS), 1.0).count() == 3


def test_line_ends_short_rows_and_bad_last_rows(spark, tmp_path):
    text = (HEADER + ROWS.replace("2 2 2 0 0 1 0 0 255", "2 2").replace("5 5 5", "5 nan 5")).replace("\n", "\r\n")
    path = write(tmp_path / "a.ply", text)
    assert [r["point_id"] for r in ply.load(spark, path).orderBy("point_id").collect()] == [0, 1, 3]
    assert ply.load(spark, path, 0.01).count() == 2
    with pytest.raises(Exception, match="isn't complete"):
        ply.load(spark, path, strict="true").collect()


@pytest.mark.parametrize(
    "text",
    [
        "", "plx\n", "ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n0\n", "ply\nformat odd 1.0\nend_header\n",
        "ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n", "ply\nformat ascii 1.0\nelement vertex 1\nproperty quad x\nend_header\n",
        "ply\nformat ascii 1.0\nelement vertex 1\n",
    ],
)
def test_bad_headers_are_refused(text):
    with pytest.raises(ValueError):
        ply.parse_header(text.encode())


@pytest.mark.parametrize("order", ["<", ">"])
def test_binary_in_parts(spark, tmp_path, order):
    name = "little" if order == "<" else "big"
    head = f"ply\nformat binary_{name}_endian 1.0\nelement vertex 10\nproperty double x\nproperty float y\nproperty int16 z\nproperty float red\nproperty double scalar_intensity\nend_header\n"
    data = b"".join(struct.pack(order + "dfhfd", k, k / 2, -k, k / 10, 3 * k) for k in range(10))
    path = write(tmp_path / "b.ply", head.encode() + data)
    df = spark.read.format("ply").option("grain", 3).load(path) if spark.dataSource.register(ply.PlySource) is None else None
    got = df.orderBy("point_id").collect()
    assert [r["point_id"] for r in got] == list(range(10)) and got[4]["x"] == 4 and got[4]["z"] == -4 and got[4]["intensity"] == 12
    assert got[4]["red"] == 102 and df.rdd.getNumPartitions() == 4
    short = write(tmp_path / "c.ply", head.encode() + data[:-5])
    assert ply.load(spark, short).count() == 9
    with pytest.raises(Exception, match="ends before"):
        ply.load(spark, short, strict="true").collect()


def test_meshes_are_written_and_read_back(spark, tmp_path):
    vertices = spark.createDataFrame([(5, 0.0, 0.0, 0.0, 1.5), (7, 1.0, 0.0, 0.0, 2.5), (9, 0.0, 1.0, 0.0, 3.5)], "vid long, x double, y double, z double, value double")
    faces = spark.createDataFrame([(0, [5, 7, 9]), (1, [9, 7, 5])], "fid long, vids array<int>")
    for ascii in (False, True):
        path = str(tmp_path / f"out{ascii}" / "m.ply")
        ply.write_mesh(vertices, faces, path, ascii)
        assert ply.load(spark, path).agg(F.sum("value")).first()[0] == 7.5
        rings = spark.read.format("ply").option("element", "face").load(path).orderBy("fid").collect()
        assert [r["vids"] for r in rings] == [[0, 1, 2], [2, 1, 0]]


def test_points_are_written_by_partition(spark, tmp_path):
    _, df = random_cloud(spark, 50)
    spark.dataSource.register(ply.PlySource)
    df.withColumn("red", F.lit(7).cast("short")).repartition(3).write.format("ply").mode("append").save(str(tmp_path / "parts"))
    back = ply.load(spark, str(tmp_path / "parts"))
    assert back.count() == 50 and back.select("point_id").distinct().count() == 50
    assert back.select("x", "y", "z").exceptAll(df.select("x", "y", "z")).count() == 0 and back.agg(F.max("red")).first()[0] == 7


def test_xyz_obj_npy_and_suffixes(spark, tmp_path):
    xyz = write(tmp_path / "a.xyz", "# text\n1 2 3\n 4\t5 6 7 8\nx y z\n1 2\n\n7 8 9\n")
    assert sorted(tuple(r)[1:] for r in points.load_points(spark, xyz).collect()) == [(1, 2, 3), (4, 5, 6), (7, 8, 9)]
    obj = write(tmp_path / "a.OBJ", "v 1 2 3\nvn 1 1 1\nv 4 5 6\nf 1 2 1\n")
    assert sorted(tuple(r)[1:] for r in points.load_points(spark, obj).collect()) == [(1, 2, 3), (4, 5, 6)]
    for kind in ("<f4", "<f8"):
        np.save(tmp_path / "a.npy", np.arange(20, dtype=kind).reshape(5, 4))
        got = points.read_npy(spark, str(tmp_path / "a.npy"), grain="2").orderBy("point_id").collect()
        assert [tuple(r) for r in got] == [(k, 4 * k, 4 * k + 1, 4 * k + 2) for k in range(5)]
    for bad in (np.zeros((2, 2)), np.zeros(3), np.zeros((2, 3), ">f8"), np.asfortranarray(np.zeros((2, 3)))):
        np.save(tmp_path / "b.npy", bad)
        with pytest.raises(ValueError):
            points.npy_header((tmp_path / "b.npy").read_bytes())
    with pytest.raises(ValueError, match="no reader"):
        points.load_points(spark, "a.las")
    with pytest.raises(ValueError, match="no points"):
        points.load_points(spark, write(tmp_path / "e.xyz", "nothing\n"))


def test_message_frames(spark):
    point = lambda *v: struct.pack("<ffff", *v)
    rows = [(0, point(1, 2, 3, 9) + point(float("nan"), 0, 0, 0) + point(4, 5, 6, 9), 16), (1, point(float("nan"), 0, 0, 0), 16), (2, b"", 16), (3, None, 16)]
    got = points.from_messages(spark.createDataFrame(rows, "frame_idx long, data binary, point_step int")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1, 2, 3), (0, 2, 4, 5, 6)]


def test_skeleton_files(spark, tmp_path):
    v = spark.createDataFrame([(k, float(k), 0.0, 0.0, [k * 10]) for k in range(6)], "sid long, x double, y double, z double, mesh_vids array<long>")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (2, 4), (4, 5)], "a long, b long")
    m = spark.createDataFrame([(k * 10, float(k), 1.0, 0.0) for k in range(6)], "vid long, x double, y double, z double")
    for _ in range(2):
        sinks.write_skeleton(v, e, m, str(tmp_path))
    lines = spark.read.text(str(tmp_path / "skeleton.obj"))
    assert lines.where("value like 'v %'").count() == 6 and {r["value"] for r in lines.where("value like 'l %'").collect()} == {"l 1 2", "l 2 3", "l 3 4", "l 3 5", "l 5 6"}
    assert spark.read.text(str(tmp_path / "correspondence.obj")).where("value like 'l %'").count() == 6
    assert spark.read.text(str(tmp_path / "polylines.txt")).where("value <> ''").count() == 3 + 2 + 3


def test_a_loop_is_one_polyline(spark):
    got = sinks.polylines(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "a long, b long")).orderBy("place").collect()
    assert [r["sid"] for r in got] == [0, 1, 2, 0]


def test_streams_keep_one_point_a_cell(spark, tmp_path):
    _, df = random_cloud(spark, 200)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = streaming.first_per_cell(stream, 0.5).writeStream.format("memory").queryName("cells").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    kept = spark.table("cells")
    assert kept.count() == clouds.occupied_cells(df, 0.5).count()
    assert kept.join(df, df.columns, "left_semi").count() == kept.count()


def test_frames_are_thinned_each(spark):
    df = cloud(spark, [(0, 0, 0), (0.01, 0, 0), (3, 3, 3)]).crossJoin(spark.range(2).withColumnRenamed("id", "frame_idx"))
    assert streaming.frames(df, 0.5).count() == 4
