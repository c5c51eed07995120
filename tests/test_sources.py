"""Sources, sinks and stateful streams on small made files."""

import os
import sqlite3
import struct
import zlib

import numpy as np
import pytest

from pointloom.sources import config, files, pointcloud2
from pointloom.streaming import stateful


def test_pcd_round_trip(spark, tmp_path):
    files.register(spark)
    rows = [(1.0, 2.0, 3.0, 7.0), (float("nan"), 0.0, 0.0, 1.0), (4.5, -2.0, 0.25, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double, intensity double").coalesce(1)
    df.write.format("pcd").mode("append").option("path", str(tmp_path / "out")).save()
    got = sorted(tuple(r)[2:] for r in spark.read.format("pcd").option("path", str(tmp_path / "out")).load().collect())
    assert got == sorted([rows[0], rows[2]])
    assert files.read_pcd(b"VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 1\nDATA ascii\n1 2 3\n")[1].tolist() == [[1, 2, 3]]
    with pytest.raises(ValueError):
        files.read_pcd(b"nothing")


def test_bag_and_capture(spark, tmp_path):
    files.register(spark)
    os.makedirs(tmp_path / "bag")
    con = sqlite3.connect(tmp_path / "bag" / "b_0.db3")
    con.executescript("CREATE TABLE topics(id INTEGER, name TEXT); CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB); INSERT INTO topics VALUES (1, '/imu'), (2, '/cloud');")
    con.executemany("INSERT INTO messages(topic_id, timestamp, data) VALUES (?, ?, ?)", [(1 + i % 2, i, bytes([i])) for i in range(25)])
    con.commit()
    con.close()
    bag = spark.read.format("rosbag2").option("path", str(tmp_path / "bag")).option("rows", "7")
    assert bag.load().count() == 25
    assert bag.option("topic", "/imu").load().count() == 13
    udp = b"hello-packet"
    ip = b"\x45\0" + struct.pack(">H", 28 + len(udp)) + b"\0" * 5 + b"\x11" + b"\0" * 10
    frame = b"\0" * 12 + b"\x08\x00" + ip + struct.pack(">HHHH", 1, 6699, 8 + len(udp), 0) + udp
    pcap = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 5, 6, len(frame), len(frame)) + frame
    (tmp_path / "a.pcap").write_bytes(pcap + b"\0\0")
    rows = spark.read.format("pcap").option("path", str(tmp_path / "a.pcap")).option("head", "6").load().collect()
    assert [(r["t_ns"], r["port"], bytes(r["data"])) for r in rows] == [(5_000_006_000, 6699, b"packet")]


def test_point_messages(spark):
    dtype = np.dtype({"names": ["x", "y", "ring"], "formats": ["<f4", "<f4", "<u2"], "offsets": [0, 4, 10], "itemsize": 16})
    x = np.zeros(3, dtype)
    x["x"], x["ring"] = [1, np.nan, 3], [7, 8, 9]
    df = spark.createDataFrame([(1, bytearray(x.tobytes()) + b"\0\0"), (2, None), (3, b"")], "frame_id bigint, data binary")
    fields = {"x": (0, 7), "ring": (10, 4)}
    got = pointcloud2.decode_points(df, fields, 16, skip_nans=True).collect()
    assert [(r["frame_id"], r["point_idx"], r["x"], r["ring"]) for r in got] == [(1, 0, 1.0, 7.0), (1, 2, 3.0, 9.0)]
    assert pointcloud2.decode_points(df, fields, 16).count() == 3
    scans = spark.createDataFrame([("A", [(1, b"abcdef"), (2, b"xyz")]), ("B", [(3, b"abcdef")])], "sensor string, packets array<struct<stamp_ns:bigint,data:binary>>")
    cut = sorted((r["sensor"], r["seq"], bytes(r["data"])) for r in pointcloud2.flatten_scans(scans, {"A": 2}).collect())
    assert cut == [("A", 0, b"ab"), ("A", 1, b"xy"), ("B", 0, b"abcdef")]


def test_gray(spark):
    rows = [(1, "rgb8", 1, 2, 7, bytes([255, 0, 0, 0, 0, 255, 9])), (2, "mono8", 1, 2, 2, b"\x05\x06")]
    df = spark.createDataFrame(rows, "id bigint, e string, h int, w int, s int, d binary")
    assert {r["id"]: bytes(r["gray"]) for r in pointcloud2.gray(df, "id", "e", "h", "w", "s", "d").collect()} == {1: bytes([76, 29]), 2: b"\x05\x06"}


def test_settings_and_pairs(spark, tmp_path):
    assert config.DecoderSettings.of({"max_distance": 50, "min_distance": None}).max_distance == 50
    with pytest.raises(KeyError):
        config.DecoderSettings.of({"nonsense": 1})
    with pytest.raises(KeyError):
        config.required({}, "x")
    assert config.as_list(3) == [3] and config.as_list(None) == []
    for n in ("001_image.png", "001_lidar.pcd", "002_image.png"):
        (tmp_path / n).write_bytes(b"x")
    assert [r["stem"] for r in files.paired_files(spark, str(tmp_path)).collect()] == ["001"]
    assert config.first_existing(["/nowhere", str(tmp_path)]) == str(tmp_path)


def test_files_through_spark(spark, tmp_path):
    (tmp_path / "a.pcd").write_bytes(files.pcd_bytes(np.array([[1.0, 2, 3, 4], [np.nan, 0, 0, 0], [5, 6, 7, 8]])))
    (tmp_path / "b.pcd").write_bytes(files.pcd_bytes(np.zeros((0, 3))))
    assert [tuple(r) for r in files.read_clouds(spark, str(tmp_path)).orderBy("point_idx").collect()] == [("a.pcd", 0, 1, 2, 3, 4), ("a.pcd", 1, 5, 6, 7, 8)]
    np.savez(tmp_path / "s.npz", planes=np.eye(2), labels=np.array(["floor", "wall"]))
    got = {r["name"]: (r["shape"], r["values"], r["texts"]) for r in files.read_arrays(spark, str(tmp_path)).collect()}
    assert got == {"planes": ([2, 2], [1, 0, 0, 1], None), "labels": ([2], None, ["floor", "wall"])}
    rgb = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    rows = b"".join(b"\0" + r.tobytes() for r in rgb)
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    assert {tuple(r)[1:] for r in files.read_pixels(spark, str(tmp_path / "p.png")).collect()} == {(u, v, *map(int, rgb[v, u])) for u in (0, 1) for v in (0, 1)}
    clouds, images = spark.createDataFrame([(1, 0.5), (2, 0.5)], "capture_idx int, x double"), spark.createDataFrame([(2, b"x"), (3, b"y")], "capture_idx int, png binary")
    files.save_pairs(clouds, images, str(tmp_path / "pairs"))
    assert {r["capture_idx"] for n in ("clouds", "images") for r in spark.read.parquet(str(tmp_path / "pairs" / n)).collect()} == {2}


def test_packed_colours_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1.5, None, 255, 1, 2), (1, 1, 2.5, 7.0, 0, 0, 3)], "frame_id int, point_idx int, x double, i double, r int, g int, b int")
    one = pointcloud2.encode_points(df, {"x": 7, "i": 2}, rgb=True).first()
    x = np.frombuffer(one["data"], np.dtype({"names": ["x", "i", "rgb"], "formats": ["<f4", "u1", "<u4"], "offsets": [0, 4, 5], "itemsize": 9}))
    assert one["width"] == 2 and one["point_step"] == 9 and x["x"].tolist() == [1.5, 2.5] and x["i"].tolist() == [0, 7] and x["rgb"].tolist() == [0xFF0102, 3]
    assert pointcloud2.encode_points(df.limit(0), {"x": 7}).count() == 0
    pytest.importorskip("yaml")
    path = str(tmp_path / "c.yaml")
    config.write_calibration(path, [0, -1, 0, 1, 0, 0, 0, 0, 1], [1, 2, 3], 0.01, {"a": 0.02})
    got = config.read_settings(path)
    assert got["transform"][0] == [0, -1, 0, 1] and abs(got["euler_deg"][2] - 90) < 1e-9 and got["num_poses"] == 1


def _stream(spark, tmp_path, name, parts, ddl, op):
    """Rows of a stateful operator over files that arrive one after the other."""
    src = tmp_path / name
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(src / f"p{k}"))
    df = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    q = op(df).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = [tuple(r) for r in spark.table(name).collect()]
    q.stop()
    return sorted(out)


def test_streams(spark, tmp_path):
    ddl = "key string, kind string, host_us bigint, stamp_us bigint, id bigint"
    parts = [[("r", "image", 5, None, 0), ("r", "clock", 10, 4, 1), ("r", "image", 20, None, 2)], [("r", "clock", 30, 27, 3), ("r", "image", 40, None, 4)], [("r", "clock", 9_000_000, 8_999_980, 5), ("r", "image", 9_000_001, None, 6)]]
    assert _stream(spark, tmp_path, "restamped", parts, ddl, stateful.restamp) == [("r", 2, 14), ("r", 4, 37), ("r", 6, 8_999_981)]
    ddl = "sensor string, seq bigint, is_info boolean, is_frame_begin boolean"
    parts = [[("s", 1, False, True), ("s", 2, True, False), ("s", 3, False, False), ("s", 4, False, True)], [("s", 5, False, False), ("s", 6, False, True)]]
    assert _stream(spark, tmp_path, "framed", parts, ddl, stateful.frames) == [("s", 4, 0), ("s", 5, 0), ("s", 6, 1)]
    ddl = "key string, kind string, t bigint, id bigint"
    parts = [[("k", "left", 1, 10), ("k", "right", 2, 20), ("k", "left", 2, 11)], [("k", "left", 3, 12)]]
    assert _stream(spark, tmp_path, "paired", parts, ddl, stateful.latest_value) == [("k", 10, None), ("k", 11, 20), ("k", 12, 20)]
    parts = [[("k", 0, 1), ("k", 400_000, 2), ("k", 600_000, 3)], [("k", 1_000_000, 4), ("k", 1_200_000, 5)]]
    assert _stream(spark, tmp_path, "debounced", parts, "key string, t bigint, id bigint", stateful.debounce) == [("k", 0, 1), ("k", 600_000, 3), ("k", 1_200_000, 5)]


def test_fan_out(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    sinks = [lambda b, n: seen.append(("a", b.count())), lambda b, n: seen.append(("b", b.count()))]
    q = stateful.fan_out(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), sinks, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert ("a", 5) in seen and ("b", 5) in seen
