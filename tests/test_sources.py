import json
import re
import struct

import numpy as np
import pytest

from pointloom.operators import coding
from pointloom.sources import colmap, documents, ply


def cloud(n):
    out = np.zeros(n, [("x", "f4"), ("y", "f4"), ("z", "f4"), ("red", "u1")])
    out["x"], out["y"], out["red"] = np.arange(n), -np.arange(n) / 3, np.arange(n) % 256
    return out


def test_ply_round_trip_and_refusals():
    rows = cloud(5)
    assert (ply.vertices(ply.ply_bytes(rows, ("made here",))) == rows).all()
    assert ply.parse_header(ply.ply_bytes(rows, ("made here",))).comments == ["made here"]
    text = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty int k\nelement face 0\nproperty list uchar int v\nend_header\n1.5 2\n-3 4\n"
    assert ply.vertices(text).tolist() == [(1.5, 2), (-3.0, 4)]
    big = b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n" + struct.pack(">f", 2.5)
    assert ply.vertices(big)["x"].tolist() == [2.5]
    for bad in (b"plx", text.replace(b"property int k", b"property list uchar int k"), big[:-1]):
        with pytest.raises(ValueError):
            ply.vertices(bad)


def test_ply_source_and_reader(spark, tmp_path):
    path = tmp_path / "a.ply"
    path.write_bytes(ply.ply_bytes(cloud(1000)))
    spark.dataSource.register(ply.PlySource)
    got = spark.read.format("ply").load(str(path))
    assert got.columns == ["row_idx", "x", "y", "z", "red"] and got.count() == 1000
    assert got.agg({"x": "sum"}).first()[0] == 499500
    many = ply.read_ply(spark, str(tmp_path), {"x": "float", "y": "float"})
    assert many.count() == 1000 and many.selectExpr("max(row_idx)").first()[0] == 999
    files = ply.write_ply(many, "path", "row_idx", {"x": "float", "y": "float"}, "").collect()
    assert ply.vertices(files[0].ply)["x"].tolist() == list(map(float, range(1000)))


def test_grouped_fields(spark):
    names = ["row_idx", "x", "y", "z", "opacity", "rot_0", "rot_1", "rot_2", "rot_3", "scale_0", "scale_1", "scale_2", "f_dc_0", "f_dc_1", "f_dc_2", *(f"f_rest_{i}" for i in range(9))]
    row = ply.grouped(spark.createDataFrame([tuple(float(i) for i in range(len(names)))], names)).first()
    assert row.xyz == [1, 2, 3] and row.rotation == [5, 6, 7, 8] and row.sh == [[12, 15, 16, 17], [13, 18, 19, 20], [14, 21, 22, 23]]


def test_colmap_text_and_binary(spark, tmp_path):
    cameras = struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 7, 1, 640, 480, 500, 510, 320, 240)
    images = struct.pack("<Q", 1) + struct.pack("<i7di", 3, 1, 0, 0, 0, 1, 2, 3, 7) + b"a.png\0" + struct.pack("<Q", 1) + struct.pack("<ddq", 1.5, 2.5, -1)
    points = struct.pack("<Q", 2) + b"".join(struct.pack("<QdddBBBdQ", i, 1, 2, 3, 4, 5, 6, 0.5, 1) + struct.pack("<ii", 3, 0) for i in (1, 2))
    (tmp_path / "cameras.bin").write_bytes(cameras)
    (tmp_path / "images.bin").write_bytes(images)
    (tmp_path / "points3D.bin").write_bytes(points)
    (tmp_path / "cameras.txt").write_text("# c\n7 PINHOLE 640 480 500 510 320 240\n")
    (tmp_path / "images.txt").write_text("# i\n3 1 0 0 0 1 2 3 7 a.png\n1.5 2.5 -1\n4 1 0 0 0 1 2 3 7 b c.png\n\n")
    (tmp_path / "points3D.txt").write_text("1 1 2 3 4 5 6 0.5 3 0\n")
    for end, n in (("bin", 1), ("txt", 2)):
        c, i = colmap.read_cameras(spark, f"{tmp_path}/cameras.{end}"), colmap.read_images(spark, f"{tmp_path}/images.{end}")
        assert i.count() == n and i.orderBy("id").first().xys == [[1.5, 2.5]] and i.orderBy("id").first().point_ids == [-1]
        v = colmap.views(i, c).orderBy("id").first()
        assert v.width == 640 and abs(v.fov_x - 2 * np.arctan(640 / 1000)) < 1e-12 and abs(v.fov_y - 2 * np.arctan(480 / 1020)) < 1e-12
    assert colmap.read_points(spark, f"{tmp_path}/points3D.bin").count() == 2
    assert colmap.read_points(spark, f"{tmp_path}/points3D.txt").first().rgb == [4, 5, 6]
    raster = np.arange(6, dtype="<f4").reshape(2, 3, 1)
    assert (colmap.raster(b"3&2&1&" + raster.transpose(1, 0, 2).tobytes(order="F")) == raster).all()


def test_transforms(spark, tmp_path):
    pose = [[1, 0, 0, 5], [0, 1, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1]]
    (tmp_path / "t.json").write_text(json.dumps({"camera_angle_x": 0.5, "frames": [{"file_path": "a", "transform_matrix": pose}, {"file_path": "b.png", "transform_matrix": pose}]}))
    from pyspark.sql import functions as F

    rows = documents.read_transforms(spark, f"{tmp_path}/t.json")
    got = rows.withColumn("view", documents.world_to_view(F.col("rotation"), F.col("centre"))).orderBy("position").collect()
    assert [r.image for r in got] == ["a.png", "b.png"] and got[0].rotation == [[1, 0, 0], [0, -1, 0], [0, 0, -1]] and got[0].centre == [5, 6, 7]
    assert got[0].view == [[1, 0, 0, -5], [0, -1, 0, 6], [0, 0, -1, 7]]


def test_a_view_does_not_carry_its_document(spark):
    docs = spark.createDataFrame([(1, "{}")], "scene int, value string").selectExpr("scene", f"from_json(value, '{documents.TRANSFORMS}') as doc")
    plan = documents.transforms(docs, "scene")._jdf.queryExecution().executedPlan().toString()
    carried = re.search(r"Generate posexplode\(.*?\), \[(.*?)\]", plan)[1]
    assert re.sub(r"#\d+", "", carried) == "scene, camera_angle_x"


def test_transforms_are_written_and_read_by_lines(spark, tmp_path):
    from pyspark.sql import functions as F

    names = {3: None, 5: 'q"\n,]}\u2028', 8: "]}", 11: "x.png,"}
    want = [(scene, i, names.get(i, f"{scene}/{i}"), i / 3) for scene in ("b", "a c", None) for i in range(700)]
    rows = spark.createDataFrame([want[i * 1009 % 2100] for i in range(2100)], "scene string, key int, name string, x double")
    pose = F.array(*(F.array(*(F.lit(float(i == k)) for k in range(3)), F.col("x")) for i in range(3)))
    views = rows.select("scene", "key", F.when(F.col("scene") == "b", 0.5).alias("camera_angle_x"), F.struct(F.col("name").alias("file_path"), pose.alias("transform_matrix")).alias("frame"))
    documents.write_transforms(views, "scene", "key", f"{tmp_path}/t")
    files = list(tmp_path.glob("t/scene=*/part-*"))
    docs = [json.loads(f.read_text()) for f in files]
    assert sorted(len(d["frames"]) for d in docs) == [700] * 3 and sorted(str(d["camera_angle_x"]) for d in docs) == ["0.5", "None", "None"]
    assert all([f["transform_matrix"][0][3] for f in d["frames"]] == [i / 3 for i in range(700)] for d in docs)
    assert max(len(line) for f in files for line in f.read_text().split("\n")) < 200
    sizes = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        got = documents.read_written_transforms(spark, f"{tmp_path}/t", "scene string")
        assert spark.read.text(f"{tmp_path}/t").rdd.getNumPartitions() > 30
        got = {(r.scene, r.position): (r.image, r.fov_x, r.centre) for r in got.collect()}
    finally:
        for k in sizes:
            spark.conf.unset(k)
    image = lambda n: n if n is None or n.endswith(".png") else f"{n}.png"
    assert got == {(s, i): (image(n), 0.5 if s == "b" else None, [x] * 3) for s, i, n, x in want}
    # One document, read as a whole, gives the same views.
    whole = documents.read_transforms(spark, str(files[0]))
    assert whole.count() == 700 and whole.selectExpr("max(position)").first()[0] == 699


def test_transforms_of_many_views_and_of_none(spark, tmp_path):
    from pointloom.plans.registry import queries

    for n in (60_000, 0):
        spark.range(n).selectExpr("id as c_custkey", "concat('c', id) as c_name", "cast(7 as int) as c_nationkey", "id / 4.0D as c_acctbal").write.parquet(f"{tmp_path}/{n}/customer.parquet")
        rows = queries()["transforms_views"](spark, f"{tmp_path}/{n}").collect()
        assert sorted(map(tuple, rows)) == [(7, i, f"c{i}.png", 7.5, float(i), -i / 4 + 0.0, 2.0) for i in range(n)]


def test_settings_and_numbers(spark, tmp_path):
    assert documents.frame_list({"start": 3, "end": 7, "step": 2}, 2) == [{"frame": 3, "timestamp": 0}, {"frame": 5, "timestamp": 1}, {"frame": 7, "timestamp": 2}]
    for bad in (([], 1), ([1, 1], 1), ([2, 1], 1), ({"start": 2, "end": 1}, 1), ([1], 0)):
        with pytest.raises(ValueError):
            documents.frame_list(*bad)
    with pytest.raises(ValueError):
        documents.checked_timestamps(documents.frame_list([1, 2], 1), [0.5, float("nan")])
    got = spark.sql("select 1.5D as x union all select double('inf')").select(documents.json_number(__import__("pyspark").sql.functions.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["1.5", '"inf"']
    documents.write_csv(spark.range(3).toDF("a"), f"{tmp_path}/c")
    assert documents.read_csv(spark, f"{tmp_path}/c", "a bigint").count() == 3
    (tmp_path / "it_7").mkdir()
    (tmp_path / "it_7" / "x.bin").write_bytes(b"1")
    (tmp_path / "it_30").mkdir()
    (tmp_path / "it_30" / "x.bin").write_bytes(b"1")
    assert documents.latest_iteration(spark, str(tmp_path)).first().iteration == 30


def test_packets_and_packing():
    rng = np.random.default_rng(0)
    for width in range(2, 17):
        top = 2 ** (width - 1) - 1
        values = rng.integers(-top, top + 1, 123)
        packed = coding.pack_signed(values, width)
        assert len(packed) == -(-123 * width // 8) and (coding.unpack_signed(packed, 123, width) == values).all()
    data = coding.packet({"frame": 3}, {"xyz": b"abc", "ids": b"", "sh": b"12345"})
    head, streams = coding.read_packet(data)
    assert head["frame"] == 3 and streams == {"xyz": b"abc", "ids": b"", "sh": b"12345"}
    for at in (3, 20, len(data) - 40, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            coding.read_packet(bytes(bad))
    box = coding.container([("a", b"xx"), ("b", b"yyy")])
    assert coding.container_member(box, "b") == b"yyy" and [m["offset"] for m in coding.container_index(box)[0]] == [0, 2]
    with pytest.raises(ValueError):
        coding.container_member(box[:-1], "b")
    with pytest.raises(ValueError):
        coding.half_floats(np.array([1e6]))


def test_states_are_checked():
    from pointloom.sources import states

    data = states.state_bytes({"x": np.arange(3, dtype="f4"), "id": np.arange(3)})
    assert states.state_arrays(data, ["x"])["x"].tolist() == [0, 1, 2]
    for bad in ({"x": np.zeros(2), "y": np.zeros(3)}, {"x": np.array([1.0, np.nan])}):
        with pytest.raises(ValueError):
            states.state_bytes(bad)
    with pytest.raises(ValueError):
        states.state_arrays(data, ["z"])


def test_states_of_no_rows(spark):
    from pointloom.sources import states

    none = states.save_states(spark.createDataFrame([], "block int, row bigint, x float"), "block", "row", {"x": "float"})
    assert states.load_states(none, {"x": "float"}).collect() == []
