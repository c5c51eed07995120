"""Normals, boundaries, feature matching and composite steps on scenes with known answers."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.operators import features as feat
from pointloom.operators.fit import icp

DDL = "id bigint, x double, y double, z double"


def scene(rng, n=9000):
    """A floor, two walls of different size and three boxes: no symmetry."""
    parts = []
    for lo, hi in (((0, 0, 0), (6, 4, 0)), ((0, 0, 0), (0, 4, 2.5)), ((0, 0, 0), (6, 0, 1.5)), ((1, 1, 0.8), (2, 1.6, 0.8)), ((1, 1, 0), (1, 1.6, 0.8)), ((1, 1.6, 0), (2, 1.6, 0.8)), ((4, 2.5, 0.4), (5.5, 3.2, 0.4)), ((4, 2.5, 0), (5.5, 2.5, 0.4)), ((3, 3, 0), (3, 3.4, 1.2)), ((3, 3, 1.2), (3.4, 3.4, 1.2))):
        lo, hi = np.array(lo, float), np.array(hi, float)
        side = np.sort(hi - lo)[1:]
        parts.append(rng.uniform(lo, hi, (int(max(200, n * side.prod() / 45)), 3)))
    return np.concatenate(parts)


def cloud(spark, x):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], DDL)


def test_normals_of_a_plane(spark):
    g = np.stack(np.meshgrid(np.arange(12) * 0.1, np.arange(12) * 0.1), axis=-1).reshape(-1, 2)
    x = np.c_[g, 0.5 * g[:, 0] + 2]
    df = cloud(spark, np.r_[x, [[50, 50, 50]]]).withColumn("g", F.lit("a")).withColumn("n", F.lit(1))
    got = feat.normals(df, ["g"], 0.15).collect()
    assert len(got) == 144
    want = np.array([0.5, 0, -1]) / np.sqrt(1.25)
    assert all(np.allclose([r["nx"], r["ny"], r["nz"]], want, atol=1e-9) for r in got)
    assert feat.normals(df.limit(0), ["g"], 0.15).count() == 0


def test_boundary_of_a_square(spark):
    g = np.stack(np.meshgrid(np.arange(8), np.arange(8)), axis=-1).reshape(-1, 2).astype(float)
    df = cloud(spark, np.c_[g, np.zeros(64)]).withColumn("g", F.lit(1))
    got = {(r["x"], r["y"]) for r in feat.boundary_points(df, ["g"], 1.5, gap=1.6, least=3).collect()}
    assert got == {(x, y) for x, y in g.tolist() if x in (0, 7) or y in (0, 7)}


def test_alignment_without_start(spark):
    rng = np.random.default_rng(3)
    a, b = scene(rng), scene(rng)
    c, s = np.cos(2.1), np.sin(2.1)
    r = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])
    here, there = np.array([3.0, 2.0, 4.0]), np.array([2.4, 2.5, 3.7])  # the two places of the sensor
    t = r @ (here - there)
    a, b = a - here, (b - there) @ r.T
    first, share = feat.global_align(cloud(spark, a), cloud(spark, b), 0.15)
    assert share > 0.8 and np.allclose(first[:3, :3], r, atol=0.1) and np.allclose(first[:3, 3], t, atol=0.3)
    total, fit, _ = icp(cloud(spark, a @ first[:3, :3].T + first[:3, 3]), cloud(spark, b), (0.3, 0.15), 8)
    assert fit > 0.9 and np.allclose((total @ first)[:3, :3], r, atol=0.02)
    nothing, none = feat.global_align(cloud(spark, a[:2]), cloud(spark, b), 0.15)
    assert none == 0 and np.allclose(nothing, np.eye(4))
