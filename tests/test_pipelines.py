"""Composite steps on made scenes, and packets as a stream."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.plans import pipelines
from pointloom.streaming.captures import packet_stream
from tests.test_features import scene

HOLES = np.array([[0.3, 0.25], [0.9, 0.3], [0.35, 0.75], [0.85, 0.7]])


def turn(a):
    c, s = np.cos(a), np.sin(a)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])


def board(rng, r, t, first):
    x = rng.uniform((0, 0), (1.2, 1.0), (16000, 2))
    x = x[np.all([np.hypot(*(x - h).T) > 0.12 for h in HOLES], axis=0)]
    p = np.c_[x, rng.normal(0, 0.002, len(x))] @ r.T + t
    return [(first + i, *map(float, q)) for i, q in enumerate(p)]


def test_holes_and_extrinsic(spark):
    rng = np.random.default_rng(1)
    up = np.array([[1, 0, 0], [0, 0, -1], [0, 1.0, 0]])
    poses = {1: (turn(0.3) @ up, np.array([2.0, 3.0, 0.5])), 2: (turn(-0.4) @ up, np.array([3.0, -1.0, 0.2]))}
    rows = [(k, *p) for k, (r, t) in poses.items() for p in board(rng, r, t, k * 100_000)]
    df = spark.createDataFrame(rows, "pose bigint, id bigint, x double, y double, z double")
    found = pipelines.hole_centers(df, ["pose"], "id", 0.12).cache()
    true = {k: np.c_[HOLES, np.zeros(4)] @ r.T + t for k, (r, t) in poses.items()}
    got = found.collect()
    assert sorted(r["pose"] for r in got) == [1] * 4 + [2] * 4
    for r in got:
        assert min(np.linalg.norm(true[r["pose"]] - [r["x"], r["y"], r["z"]], axis=1)) < 0.02 and abs(r["r"] - 0.12) < 0.02
    # the camera sees the same centers from elsewhere
    cr, ct = turn(1.0), np.array([0.1, -0.2, 0.3])
    seen = [(k, i, *map(float, cr @ p + ct)) for k, ps in true.items() for i, p in enumerate(ps[::-1])] + [(3, 0, 0.0, 0.0, 0.0)]
    r, t, rms, by = pipelines.extrinsic(found.select("pose", F.col("hole").alias("k"), "x", "y", "z"), spark.createDataFrame(seen, "pose bigint, k bigint, x double, y double, z double"), "pose", "k")
    assert np.allclose(np.array(r).reshape(3, 3), cr, atol=0.02) and np.allclose(t, ct, atol=0.05) and rms < 0.02 and by.count() == 2
    with pytest.raises(ValueError):
        pipelines.extrinsic(found.select("pose", F.col("hole").alias("k"), "x", "y", "z").limit(0), found.select("pose", F.col("hole").alias("k"), "x", "y", "z").limit(0), "pose", "k")


def test_clouds_are_registered(spark):
    rng = np.random.default_rng(5)
    rows, true = [], {}
    for k, (angle, at) in enumerate((((0.0), (3, 2, 1.5)), (0.08, (3.2, 2.1, 1.5)))):
        r = turn(angle)
        rows += [(f"c{k}", *map(float, p)) for p in (scene(rng, 5000) - np.array(at)) @ r]
        true[f"c{k}"] = np.c_[r, np.array(at) - np.array([3, 2, 1.5])]
    clouds = spark.createDataFrame([*rows, (None, 0.0, 0.0, 0.0)], "cloud string, x double, y double, z double")
    transforms, merged = pipelines.register_clouds(clouds, "cloud", 0.15)
    for t in transforms.collect():
        m = np.array(t["m"]).reshape(3, 4)
        assert t["fitness"] > 0.8 and np.allclose(m, true[t["cloud"]], atol=0.05), t
    assert 0 < merged.count() < 3 * 5000
    none, empty = pipelines.register_clouds(clouds.limit(0), "cloud", 0.15)
    assert none.count() == 0 and empty.count() == 0


def test_captures_as_a_stream(spark, tmp_path):
    for n in range(3):
        udp = f"head{n}".encode()
        ip = b"\x45\0" + struct.pack(">H", 28 + len(udp)) + b"\0" * 5 + b"\x11" + b"\0" * 10
        frame = b"\0" * 12 + b"\x08\x00" + ip + struct.pack(">HHHH", 1, 6699 + n % 2, 8 + len(udp), 0) + udp
        (tmp_path / f"{n}.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", n, 6, len(frame), len(frame)) + frame)
    q = packet_stream(spark, str(tmp_path), port=6699, head=4).writeStream.format("memory").queryName("packets").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["file"], r["t_ns"], bytes(r["data"])) for r in spark.table("packets").collect()) == [("0.pcap", 6000, b"0"), ("2.pcap", 2_000_006_000, b"2")]
