"""Pattern search, correspondences, undistortion and the extra writers."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.functions import geometry as geo
from pointloom.operators import calibration as cal
from pointloom.operators import fit
from pointloom.sources import sinks

BOARD = [(-0.5, 0.4), (0.5, 0.4), (0.6, -0.4), (-0.5, -0.3)]


def test_pattern_is_found(spark):
    rng = np.random.default_rng(0)
    rows = []
    for pose in (1, 2):
        c, s = np.cos(pose), np.sin(pose)
        x = np.array(BOARD) @ np.array([[c, s], [-s, c]]) + rng.normal(0, 0.003, (4, 2)) + 3
        rows += [(pose, 10 + k, *map(float, p)) for k, p in enumerate(x)]
        rows += [(pose, 50 + k, *map(float, p)) for k, p in enumerate(rng.uniform(0, 6, (6, 2)))]
    rows.append((3, 1, 0.0, 0.0))
    got = {r["pose"]: list(r["ids"]) for r in cal.find_pattern(spark.createDataFrame(rows, "pose bigint, id bigint, x double, y double"), "pose", "id", BOARD, 0.05).collect()}
    assert got == {1: [10, 11, 12, 13], 2: [10, 11, 12, 13]}


def test_order_and_residuals(spark):
    board = [(*p, 0.0) for p in BOARD]
    c, s = np.cos(0.4), np.sin(0.4)
    r, t = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]]), np.array([1.0, 2.0, 3.0])
    x = (np.array(board) - t) @ r  # so that R x + t is the board
    rows = [(7, k, *map(float, x[p])) for k, p in enumerate((2, 0, 3, 1))]
    pairs = cal.correspond(spark.createDataFrame(rows, "pose bigint, k bigint, x double, y double, z double"), "pose", "k", board)
    assert [p["place"] for p in sorted(pairs.collect(), key=lambda p: p["k"])] == [2, 0, 3, 1]
    f = fit.rigid_fit(pairs, ["pose"]).first()
    assert np.allclose(f["t"], t, atol=1e-6)
    worst = cal.pose_residuals(pairs, "pose", f["r"], f["t"]).first()
    assert worst["n"] == 4 and worst["rms"] < 1e-6


def test_undistorted_inverts_the_lens(spark):
    k = (-0.012, 0.0031, -0.0011, 0.0002)
    df = spark.createDataFrame([(0.3, -0.2, 1.0), (0.0, 0.0, 1.0), (1.2, 0.9, 1.0)], "x double, y double, z double")
    u, v = geo.fisheye(("x", "y", "z"), 500, 510, 320, 240, k)
    x, y = cal.undistorted(F.col("u"), F.col("v"), 500, 510, 320, 240, k)
    for r in df.withColumns({"u": u, "v": v}).withColumns({"bx": x, "by": y}).collect():
        assert abs(r["bx"] - r["x"]) < 1e-9 and abs(r["by"] - r["y"]) < 1e-9


def test_writers(spark, tmp_path):
    s = spark.createDataFrame([("a", 10.5, 1.0), ("b", 10.0, 2.5)], "sensor string, t double, value double")
    sinks.write_long_csv(s, str(tmp_path / "csv"))
    got = sorted(map(tuple, spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()))
    assert got == [("a", "10.500000000", "0.500000000", "1.000000"), ("b", "10.000000000", "0.000000000", "2.500000")]
    v = spark.createDataFrame([("p", 0), ("p", 1), ("q", 0)], "mesh string, vid bigint")
    t = spark.createDataFrame([("q", 0, 0, 0)], "mesh string, a bigint, b bigint, c bigint")
    v2, t2 = sinks.numbered_mesh(v, t, "mesh", "vid")
    assert sorted(r["vid"] for r in v2.collect()) == [0, 1, 2] and t2.first()["a"] == 2
    path = str(tmp_path / "table")
    spark.range(3).write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [10, 11, 12]
