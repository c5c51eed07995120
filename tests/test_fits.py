"""Geometry and fits on made scenes with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import geometry as geo
from pointloom.operators import fit
from pointloom.operators.graph import connected_components
from pointloom.plans import pipelines


def cloud(spark, x, g="a"):
    return spark.createDataFrame([(g, i, *map(float, p)) for i, p in enumerate(x)], "g string, id bigint, x double, y double, z double")


def room(rng, n=400):
    u = rng.uniform(0, 4, (n, 2))
    noise = rng.normal(0, 0.003, n)
    return np.concatenate([np.c_[u, noise], np.c_[u[:, 0], noise, u[:, 1] + 0.2], np.c_[noise, u[:, 0], u[:, 1] + 0.2][: n // 2], rng.uniform(0.5, 3.5, (40, 3))])


def test_planes_of_a_room(spark):
    x = room(np.random.default_rng(0))
    planes, points = pipelines.segment(cloud(spark, x), ["g"], "id", 0.02, 3, 50)
    got = sorted(planes.collect(), key=lambda r: r["plane"])
    assert sorted(r["axis"] for r in got) == ["+x", "+y", "+z"]  # inward
    assert all(abs(abs(r[r["axis"][1:].replace("x", "a").replace("y", "b").replace("z", "c")]) - 1) < 0.01 and abs(r["d"]) < 0.02 for r in got)
    assert points.where("plane = -1").count() >= 30
    assert fit.peel_planes(cloud(spark, x[:2]), ["g"], "id", 0.02, 2, 50).count() == 0


def test_kabsch_and_registration(spark):
    rng = np.random.default_rng(1)
    x = room(rng)
    c, s = np.cos(0.03), np.sin(0.03)
    r, t = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]]), np.array([0.05, -0.04, 0.03])
    y = x @ r.T + t
    pairs = spark.createDataFrame([("a", *map(float, (*p, *q))) for p, q in zip(x, y, strict=True)], "g string, ax double, ay double, az double, bx double, by double, bz double")
    one = fit.rigid_fit(pairs, ["g"]).first()
    assert np.allclose(np.array(one["r"]).reshape(3, 3), r, atol=1e-8) and np.allclose(one["t"], t, atol=1e-8) and one["rms"] < 1e-5
    total, share, rms = fit.icp(cloud(spark, x).drop("g"), cloud(spark, y).drop("g"), (0.5, 0.2), 15)
    assert np.allclose(total[:3, :3], r, atol=0.02) and np.allclose(total[:3, 3], t, atol=0.05) and share > 0.9 and rms < 0.1


def test_hull_in_parts(spark):
    x = np.random.default_rng(2).standard_normal((500, 2))
    df = spark.createDataFrame([("a", *map(float, p)) for p in x], "g string, x double, y double")
    got = {(r["x"], r["y"]) for r in fit.convex_hulls(df, ["g"], 7).collect()}
    assert got == {tuple(map(float, p)) for p in fit.hull(x)}


def test_flat_and_tiled_meshes(spark, tmp_path):
    from pointloom.sources.sinks import ply_lines, write_ply

    rng = np.random.default_rng(3)
    u = rng.uniform(0, 2, (1500, 2))
    pts = cloud(spark, np.concatenate([np.c_[u, np.full(len(u), 0.5)], [[1, 1, 3.0]]])).withColumnRenamed("g", "room")
    planes = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, -0.5), ("a", 1, 1.0, 0.0, 0.0, -9.0)], "room string, plane int, a double, b double, c double, d double")
    v, t = pipelines.hull_meshes(pts, planes, ["room"], 0.05)
    corners = {r["id"]: (r["x"], r["y"], r["z"]) for r in v.collect()}
    area = sum(np.linalg.norm(np.cross(np.subtract(corners[r["b"]], corners[r["a"]]), np.subtract(corners[r["c"]], corners[r["a"]]))) / 2 for r in t.collect())
    assert abs(area - 4) < 0.1 and all(abs(c[2] - 0.5) < 1e-9 for c in corners.values())
    tiles = pipelines.surface_tiles(pts.withColumn("r", F.lit(0.25)), planes, ["room"], 0.05, 0.2, 0.2).collect()
    assert len(tiles) > 80 and all(abs(r["z"] - 0.5) < 1e-6 and abs(r["r"] - 0.25) < 1e-9 for r in tiles)
    mesh = v.withColumn("mesh", F.lit("m"))
    lines = ply_lines(mesh.select("mesh", "id", "x", "y", "z"), t.select(F.lit("m").alias("mesh"), "k", "a", "b", "c"), "mesh")
    write_ply(lines, "mesh", str(tmp_path / "ply"))
    text = spark.read.text(str(tmp_path / "ply")).collect()
    assert text[0]["value"] == "ply" and len(text) == 9 + len(corners) + t.count()


def test_relabel_compare_and_filter(spark):
    s = spark.createDataFrame([("a",), ("b",), (None,)], "label string")
    out, unknown = pipelines.relabel(s, "label", {"a": "floor", "zzz": "q"})
    assert {r["label"] for r in out.collect()} == {"floor", "b", None} and unknown == ["zzz"]
    p = cloud(spark, [[0, 0, 1.0], [0, 0, 5.0]])
    assert pipelines.distance_filter(p, (0, 0, 1, 0)).count() == 1
    both = pipelines.compare_maps(p.withColumns({"r": F.lit(0.5), "g": F.lit(0.5), "b": F.when(F.col("z") > 2, 0.5)}), p, [[1, 0, 0, 9], [0, 1, 0, 0], [0, 0, 1, 0]], stored=True)
    assert {(r["map"], r["x"], r["r"]) for r in both.collect()} == {("a", 0, 0.5), ("a", 0, 0.2), ("b", 9, 0.1)}


def test_peaks():
    v = np.array([0, 3, 0, 1, 0, 5, 5, 5, 0, 2, 1.9, 2.1, 0], float)
    assert fit.peaks(v, 1, 0.5).tolist() == [1, 3, 6, 11]
    assert fit.peaks(v, 4, 0.5).tolist() == [1, 6, 11]


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 2), (10, 11), (None, 4), (5, 5), *[(100 + i, 101 + i) for i in range(60)]]
    got = dict(map(tuple, connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **{100 + i: 100 for i in range(61)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_expressions(spark):
    one = spark.createDataFrame([(3.0, 4.0, 0.0, float("nan"), 1_500_000_000, -1)], "x double, y double, z double, n double, t bigint, u bigint")
    sec, nano = geo.stamp_split(F.col("t"))
    s2, n2 = geo.stamp_split(F.col("u"))
    r = one.select(
        geo.norm("x", "y", "z").alias("r"), geo.finite("x", "n").alias("f"), geo.inside_box((0, 0, 0), (5, 5, 5), ("x", "y", "n")).alias("b"), geo.azimuth_gate(350, 60).alias("a"),
        sec.alias("s"), nano.alias("ns"), s2.alias("s2"), n2.alias("n2"), geo.pack_rgb(F.lit(1), F.lit(2), F.lit(3)).alias("rgb"), geo.dominant_axis("x", "y", "z").alias("d"),
        geo.fisheye(("z", "z", "x"), 500, 500, 320, 240, (0, 0, 0, 0))[0].alias("u"),
    ).first()
    assert tuple(r) == (5.0, False, False, True, 1, 500_000_000, -1, 999_999_999, 66051, "+y", 320.0)


def test_measure_and_merge(spark):
    x = [(0, 0, 1.0), (0, 0, 2.0), (0, 0, -1.0), (0, 0, 5.0)]
    m = pipelines.measure(cloud(spark, x), ["g"], (0, 0, 1, 0)).first()
    assert (m["n"], m["nearest"], m["farthest"], m["in_band"]) == (3, 1.0, 5.0, 2) and m["mean"] == pytest.approx(8 / 3)
    t = spark.createDataFrame([("a", [float(v) for v in (1, 0, 0, 1, 0, 1, 0, 0, 0, 0, 1, 0)])], "g string, m array<double>")
    v = pipelines.merge_clouds(cloud(spark, [(0.1, 0.1, 0.1), (0.3, 0.1, 0.1)]), t, "g", ["g"], 0.5).first()
    assert v["x"] == pytest.approx(1.2) and v["n"] == 2


def test_colorize(spark):
    pts = spark.createDataFrame([("i", 1, 0.0, 0.0, 2.0), ("i", 2, 0.0, 0.0, -2.0), ("j", 3, 0.0, 0.0, 2.0)], "img string, id bigint, x double, y double, z double")
    px = spark.createDataFrame([("i", 5, 5, 9, 8, 7)], "img string, u int, v int, r int, g int, b int")
    eye = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    got = {r["id"]: r["r"] for r in pipelines.colorize(pts, px, "img", eye, {"fx": 10.0, "fy": 10.0, "cx": 5.0, "cy": 5.0}, (0, 0, 0, 0), 10, 10).collect()}
    assert got == {1: 9, 2: None, 3: None}


def slabs(shares, n, seed=4):
    """Horizontal planes a metre apart with the given shares of ``n`` points, the rest scattered."""
    rng = np.random.default_rng(seed)
    parts = [np.c_[rng.uniform(0, 20, (int(n * s), 2)), k + rng.normal(0, 0.004, int(n * s))] for k, s in enumerate(shares)]
    rest = n - sum(map(len, parts))
    return np.concatenate([*parts, rng.uniform((0, 0, 10), (20, 20, 40), (rest, 3))])


@pytest.mark.parametrize("whole", [200_000, 3000])
def test_small_surfaces_are_found_until_none_is_left(spark, whole):
    """Six surfaces of 10 % of the points each: more than three, and too small for 200 triples of a sample."""
    x = slabs([0.1] * 6, 8000)
    found = fit.peel_planes(cloud(spark, x), ["g"], "id", 0.02, least=400, whole=whole).orderBy("plane").collect()
    assert [r["plane"] for r in found] == list(range(6)) and all(r["inliers"] >= 700 for r in found)
    assert sorted(round(-r["d"] * np.sign(r["c"])) for r in found) == list(range(6))


def test_the_largest_plane_of_many_points(spark):
    """The winner is the largest of all points, drawn from all of them; a small sample prefers either."""
    x = slabs([0.14, 0.12], 30_000)
    one = fit.ransac_planes(cloud(spark, x), ["g"], "id", 0.02).first()
    assert abs(one["d"]) < 0.02 and abs(abs(one["c"]) - 1) < 0.001 and one["inliers"] > 4100


def test_session_planes_have_no_cap(spark, sf):
    from pointloom.plans.reference_queries import QUERIES

    rows = QUERIES["session_planes"](spark, sf).collect()
    assert max(r["plane"] for r in rows) > 2 and min(r["inliers"] for r in rows) >= 50
