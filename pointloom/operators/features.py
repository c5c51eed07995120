"""Neighbour pairs, normals, boundary points, feature histograms and alignment without a start.

All are joins of a thinned cloud with itself by grid cell. In a cloud with one point per voxel a point has a
bounded number of neighbours (the ratio of the volumes), however many points the cloud has; so thin first
(``thinned``). Columns that are not named are ignored, points with nulls belong to no cell and drop out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.fit import closest_points, kabsch
from pointloom.operators.spatial import cell, voxel_mean
from pointloom.session import materialize

BINS = 11
MATCH_SAMPLE, HYPOTHESES = 1000, 4000


def thinned(points: DataFrame, keys: list[str], voxel: float) -> DataFrame:
    """keys, id, x, y, z: the mean of each voxel, with an id made from the voxel's place."""
    v = voxel_mean(points, keys, voxel, ["x", "y", "z"])
    return v.select(*keys, F.xxhash64("vx", "vy", "vz").alias("id"), "x", "y", "z")


def neighbour_pairs(points: DataFrame, keys: list[str], radius: float, carry: list[str] | None = None) -> DataFrame:
    """keys, a, b, pa, pb, d2: ordered pairs of different points (``id``) at most ``radius`` apart, with their
    structs of x, y, z and the columns of ``carry``."""
    body = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", *(carry or []))])
    cells = [cell(c, radius).alias(f"c{c}") for c in "xyz"]
    left = points.select(*keys, F.col("id").alias("a"), body.alias("pa"), *cells)
    right = points.select(*keys, F.col("id").alias("b"), body.alias("pb"), *cells)
    for c in ("cx", "cy", "cz"):
        right = right.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    d2 = sum((F.col(f"pa.{c}") - F.col(f"pb.{c}")) * (F.col(f"pa.{c}") - F.col(f"pb.{c}")) for c in "xyz")
    pairs = left.join(right, [*keys, "cx", "cy", "cz"]).where(F.col("a") != F.col("b")).withColumn("d2", d2)
    return pairs.where(F.col("d2") <= radius * radius).select(*keys, "a", "b", "pa", "pb", "d2")


def normals(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """keys, id, x, y, z, nx, ny, nz: direction of least spread of a point and its neighbours, turned towards the
    origin (the sensor). Points with fewer than two neighbours have none and are left out."""
    d = {c: F.col(f"pb.{c}") - F.col(f"pa.{c}") for c in "xyz"}
    sums = [F.sum(d[c]).alias(f"s{c}") for c in "xyz"] + [F.sum(d[p] * d[q]).alias(f"s{p}{q}") for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")]
    m = neighbour_pairs(points, keys, radius).groupBy(*keys, F.col("a").alias("id"), "pa").agg((F.count("*") + 1).alias("n"), *sums).where("n >= 3")
    heads = "".join(f"{k} {points.schema[k].dataType.simpleString()}, " for k in keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["n"].to_numpy(float)
            mean = pdf[["sx", "sy", "sz"]].to_numpy() / n[:, None]
            full = pdf[["sxx", "sxy", "sxz", "sxy", "syy", "syz", "sxz", "syz", "szz"]].to_numpy().reshape(-1, 3, 3) / n[:, None, None]
            v = np.linalg.eigh(full - mean[:, :, None] * mean[:, None, :])[1][:, :, 0] if len(pdf) else np.zeros((0, 3))
            p = pdf[["x", "y", "z"]].to_numpy()
            v = np.where(((v * p).sum(axis=1) > 0)[:, None], -v, v)
            yield pdf[[*keys, "id", "x", "y", "z"]].assign(nx=v[:, 0], ny=v[:, 1], nz=v[:, 2])

    flat = m.select(*keys, "id", "pa.x", "pa.y", "pa.z", *[c for c in m.columns if c.startswith("s") or c == "n"])
    return flat.mapInPandas(solve, heads + f"id {points.schema['id'].dataType.simpleString()}, x double, y double, z double, nx double, ny double, nz double")


def boundary_points(points: DataFrame, keys: list[str], radius: float, gap: float = math.pi / 2, least: int = 3) -> DataFrame:
    """keys, id, x, y, z, gap: points of a plane cloud (x, y; z = 0) whose neighbours leave an angle wider than
    ``gap`` open. Points with fewer than ``least`` neighbours are no boundary."""
    angle = F.atan2(F.col("pb.y") - F.col("pa.y"), F.col("pb.x") - F.col("pa.x"))
    around = neighbour_pairs(points, keys, radius).groupBy(*keys, F.col("a").alias("id"), "pa").agg(F.array_sort(F.collect_list(angle)).alias("t"))
    around = around.where(F.size("t") >= least)
    steps = F.zip_with(F.slice("t", 2, F.size("t") - 1), F.slice("t", 1, F.size("t") - 1), lambda hi, lo: hi - lo)
    wrap = 2 * math.pi + F.element_at("t", 1) - F.element_at("t", -1)
    wide = around.withColumn("gap", F.greatest(F.array_max(steps), wrap))
    return wide.where(F.col("gap") > gap).select(*keys, "id", "pa.x", "pa.y", "pa.z", "gap")


def _angle_bins(keys: list[str]):
    """Bins of the three angles of each pair, whole batches at a time."""

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = lambda p, c: np.stack([batch.column(f"{p}{k}").to_numpy(zero_copy_only=False) for k in c], axis=1)
            xa, xb, na, nb = (take(p, c) for p, c in (("a", "xyz"), ("b", "xyz"), ("a", ("nx", "ny", "nz")), ("b", ("nx", "ny", "nz"))))
            line = (xb - xa) / np.sqrt(batch.column("d2").to_numpy())[:, None]
            # the frame stands on the point whose normal lies closer to the line
            turn = (np.abs((na * line).sum(axis=1)) < np.abs((nb * line).sum(axis=1)))[:, None]
            u, other, way = np.where(turn, nb, na), np.where(turn, na, nb), np.where(turn, -line, line)
            v = np.cross(way, u)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.maximum(size, 1e-9)
            w = np.cross(u, v)
            figures = ((v * other).sum(axis=1), (u * way).sum(axis=1), np.arctan2((w * other).sum(axis=1), (u * other).sum(axis=1)) / math.pi)
            parts = [np.clip(np.floor((f + 1) / 2 * BINS), 0, BINS - 1).astype(np.int32) for f in figures]
            keep = [*keys, "a", "b", "d2"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *map(pa.array, parts)], [*keep, "p0", "p1", "p2"]).filter(pa.array(size[:, 0] > 1e-9))

    return angles


def feature_histograms(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """keys, id, x, y, z, f (33 numbers): fast point feature histograms. ``points`` as from ``normals``.

    Each pair of near points gives three angles between their normals and the line that joins them; a point's own
    histogram counts them in ``BINS`` bins each (in hundredths), the feature adds its neighbours' histograms
    weighted by one over squared distance. Points without neighbours are left out."""
    pairs = neighbour_pairs(points, keys, radius, ["nx", "ny", "nz"]).where("d2 > 0")
    body = ("x", "y", "z", "nx", "ny", "nz")
    flat = pairs.select(*keys, "a", "b", "d2", *[F.col(f"p{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in body])
    kinds = "".join(f"{k} {flat.schema[k].dataType.simpleString()}, " for k in (*keys, "a", "b", "d2"))
    angles = flat.mapInArrow(_angle_bins(keys), kinds + "p0 int, p1 int, p2 int")
    angles = materialize(angles, "angles")
    own = angles.groupBy(*keys, "a").agg(F.array(*[100 * F.avg((F.col(f"p{s}") == k).cast("double")) for s in range(3) for k in range(BINS)]).alias("_h"))
    own = materialize(own, "histograms")
    near = angles.select(*keys, "a", "b", "d2").join(own.withColumnRenamed("a", "b"), [*keys, "b"])
    rest = near.groupBy(*keys, "a").agg(F.array(*[F.avg(F.col("_h")[k] / F.col("d2")) for k in range(3 * BINS)]).alias("_g"))
    third_sum = lambda s: F.aggregate(F.slice("_g", 1 + s * BINS, BINS), F.lit(0.0), lambda t, x: t + x)
    scaled = F.array(*[F.col("_g")[k] * 100 / F.when(third_sum(k // BINS) > 0, third_sum(k // BINS)) for k in range(3 * BINS)])
    joined = own.join(rest.select(*keys, "a", scaled.alias("_g")), [*keys, "a"]).select(*keys, F.col("a").alias("id"), F.zip_with("_h", "_g", lambda p, q: p + F.coalesce(q, F.lit(0.0))).alias("f"))
    return points.select(*keys, "id", "x", "y", "z").join(joined, [*keys, "id"])


def nearest_features(asked: np.ndarray, among: DataFrame) -> DataFrame:
    """row, id, x, y, z, d2: for each row of ``asked`` (a bounded matrix, shipped with the tasks) the nearest
    feature ``f`` of all rows of ``among``; of equal ones the smaller id. Tasks send one row per asked row."""
    squares = (asked * asked).sum(axis=1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("f").flatten().to_numpy().reshape(batch.num_rows, -1)
            body = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            x, body, ids = x[order], body[order], ids[order]
            d = squares[:, None] + (x * x).sum(axis=1)[None] - 2 * asked @ x.T
            k = d.argmin(axis=1)
            found = (d[np.arange(len(asked)), k], ids[k], body[k])
            if best is None:
                best = found
            else:
                better = (found[0] < best[0]) | ((found[0] == best[0]) & (found[1] < best[1]))
                best = tuple(np.where(better if p.ndim == 1 else better[:, None], q, p) for p, q in zip(best, found, strict=True))
        if best is not None and len(asked):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked))), pa.array(best[1]), *[pa.array(best[2][:, c]) for c in range(3)], pa.array(best[0])], ["row", "id", "x", "y", "z", "d2"])

    rows = among.select("id", "x", "y", "z", "f").mapInArrow(search, "row bigint, id bigint, x double, y double, z double, d2 double")
    return rows.groupBy("row").agg(F.min(F.struct("d2", "id", "x", "y", "z")).alias("m")).select("row", "m.id", "m.x", "m.y", "m.z", "m.d2")


def global_align(a: DataFrame, b: DataFrame, voxel: float, seed: int = 0) -> tuple[np.ndarray, float]:
    """4×4 transform taking cloud ``a`` onto ``b`` (x, y, z each) without a start, and the share of thinned points
    of ``a`` that then have one of ``b`` within 1.5 voxels.

    Features of ``MATCH_SAMPLE`` points of the thinned ``a``, those of smallest hashed id, are matched with all of
    ``b`` and back with all of ``a``; mutual matches (at most as many rows, on the driver) vote on rigid motions
    of three matches whose edges agree in length. Without three mutual matches the transform is the identity, the
    share 0."""
    sides = []
    for cloud in (a, b):
        thin = materialize(thinned(cloud.withColumn("g", F.lit(0)), ["g"], voxel), "thin")
        sides.append((thin, materialize(feature_histograms(normals(thin, ["g"], 2 * voxel), ["g"], 5 * voxel), "features")))
    (thin_a, fa), (thin_b, fb) = sides
    some = fa.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(MATCH_SAMPLE).collect()
    there = {r["row"]: r for r in nearest_features(np.array([r["f"] for r in some]).reshape(-1, 3 * BINS), fb).collect()}
    hits = sorted({r["id"] for r in there.values()})
    fhits = {r["id"]: r["f"] for r in fb.where(F.col("id").isin(hits)).select("id", "f").collect()} if hits else {}
    back = {hits[r["row"]]: r["id"] for r in nearest_features(np.array([fhits[h] for h in hits]).reshape(-1, 3 * BINS), fa).collect()}
    mutual = [(some[k], r) for k, r in sorted(there.items()) if back.get(r["id"]) == some[k]["id"]]
    if len(mutual) < 3:
        return np.eye(4), 0.0
    p, q = (np.array([[m[s][c] for c in "xyz"] for m in mutual]) for s in (0, 1))
    rng = np.random.default_rng(seed)
    best, most = None, -1
    for _ in range(HYPOTHESES):
        k = rng.choice(len(p), 3, replace=False)
        la, lb = (np.linalg.norm(x[k] - x[np.roll(k, 1)], axis=1) for x in (p, q))
        if (np.minimum(la, lb) < 0.9 * np.maximum(la, lb)).any() or la.min() < 2 * voxel:
            continue
        r, t = kabsch(p[k].T @ q[k], 3, p[k].mean(axis=0), q[k].mean(axis=0))
        near = ((p @ r.T + t - q) ** 2).sum(axis=1) <= (1.5 * voxel) ** 2
        if near.sum() > most:
            best, most = near, int(near.sum())
    if best is None or most < 3:
        return np.eye(4), 0.0
    r, t = kabsch(p[best].T @ q[best], most, p[best].mean(axis=0), q[best].mean(axis=0))
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, t
    moved = thin_a.select("id", *[(sum(float(out[i, j]) * F.col(c) for j, c in enumerate("xyz")) + float(out[i, 3])).alias("xyz"[i]) for i in range(3)])
    count = thin_a.count()
    return out, closest_points(moved, thin_b, 1.5 * voxel).count() / max(count, 1)
