"""Composite steps: segmentation, measuring, colouring, merging and registration of clouds, board calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import geometry as geo
from pointloom.operators.calibration import correspond_targets, pose_residuals
from pointloom.operators.features import boundary_points, global_align, neighbour_pairs, thinned
from pointloom.operators.fit import convex_hulls, icp, peel_planes, ransac_planes, rigid_fit
from pointloom.operators.graph import connected_components
from pointloom.operators.spatial import circle_fit, plane_fit, voxel_first, voxel_mean
from pointloom.session import materialize


def segment(points: DataFrame, keys: list[str], id: str, thresh: float = 0.05, most: int = 5, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """(planes with inward normals and axis, points with their nearest plane or -1)."""
    planes = peel_planes(points, keys, id, thresh, most, least)
    middle = points.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    side = geo.plane_distance("a", "b", "c", "d", ("mx", "my", "mz"))
    turned = planes.join(middle, keys).withColumn("_s", F.when(side < 0, -1.0).otherwise(1.0))
    planes = turned.select(*keys, "plane", *[(F.col(c) * F.col("_s")).alias(c) for c in "abcd"], "inliers").withColumn("axis", geo.dominant_axis("a", "b", "c"))
    packed = planes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("plane", "a", "b", "c", "d"))).alias("ps"))
    far = lambda p: F.abs(p["a"] * F.col("x") + p["b"] * F.col("y") + p["c"] * F.col("z") + p["d"])
    best = F.array_min(F.transform("ps", lambda p: F.struct(far(p).alias("dist"), p["plane"].alias("plane"))))
    near = points.join(packed, keys, "left").withColumn("_b", best)
    plane = F.when(F.col("_b.dist") < thresh, F.col("_b.plane")).otherwise(-1)
    return planes, near.withColumns({"plane": plane, "dist": F.col("_b.dist")}).drop("ps", "_b")


def measure(points: DataFrame, keys: list[str], plane: tuple[float, float, float, float], lo: float = 0.0, hi: float = 3.0) -> DataFrame:
    """Figures of the distances to a plane on its positive side, and how many lie in the band."""
    s = points.withColumn("_d", geo.plane_distance(*plane))
    up = F.when(F.col("_d") > 0, F.col("_d"))
    return s.groupBy(*keys).agg(F.count(up).alias("n"), F.min(up).alias("nearest"), F.max(up).alias("farthest"), F.avg(up).alias("mean"), F.stddev_pop(up).alias("std"), F.count_if(F.col("_d").between(lo, hi)).alias("in_band"))


def colorize(points: DataFrame, pixels: DataFrame, image: str, extrinsic, camera: dict, k, width: int, height: int) -> DataFrame:
    """``points`` with r, g, b of the pixel they fall on; points outside the image or without one keep nulls.
    ``pixels``: image, u, v, r, g, b."""
    x, y, z = geo.rigid(extrinsic)
    p = points.withColumns({"_x": x, "_y": y, "_z": z})
    u, v = geo.fisheye(("_x", "_y", "_z"), **camera, k=k)
    p = p.withColumns({"_u": F.rint(u), "_v": F.rint(v)})
    seen = (F.col("_z") > 0.1) & F.col("_u").between(0, width - 1) & F.col("_v").between(0, height - 1)
    p = p.withColumns({"u": F.when(seen, F.col("_u").cast("int")), "v": F.when(seen, F.col("_v").cast("int"))})
    return p.join(pixels, [image, "u", "v"], "left").drop("_x", "_y", "_z", "_u", "_v")


def merge_clouds(points: DataFrame, transforms: DataFrame, cloud: str, keys: list[str], voxel: float, colours: tuple[str, ...] = ()) -> DataFrame:
    """Clouds moved by their 3×4 transforms (cloud, m array<double> of 12) and averaged by voxel, ``colours`` with them (points
    without a colour don't count for it)."""
    m = F.col("m")
    rows = [[m[4 * r + c] for c in range(4)] for r in range(3)]
    moved = points.join(transforms, cloud).select(*keys, *[e.alias(n) for e, n in zip(geo.rigid(rows), "xyz", strict=True)], *colours)
    return voxel_mean(moved, keys, voxel, ["x", "y", "z", *colours])


def compare_maps(a: DataFrame, b: DataFrame, m, colour_a=(0.2, 0.4, 1.0), colour_b=(0.1, 0.9, 0.3), stored: bool = False) -> DataFrame:
    """Both maps in the frame of ``a``: map, x, y, z, r, g, b; ``m`` (3×4) moves ``b``. Each has one colour, or with ``stored``
    its own r, g, b where it has them."""
    out = None
    for name, df, colour in (("a", a, colour_a), ("b", b, colour_b)):
        xyz = geo.rigid(m) if name == "b" else [F.col(c) for c in "xyz"]
        rgb = geo.colour_or("rgb", colour) if stored and {"r", "g", "b"} <= set(df.columns) else [F.lit(float(c)) for c in colour]
        one = df.select(F.lit(name).alias("map"), *[e.alias(c) for e, c in zip([*xyz, *rgb], "xyzrgb", strict=True)])
        out = one if out is None else out.unionByName(one)
    return out


def relabel(df: DataFrame, column: str, renames: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """(``df`` with labels renamed, old names that no row has)."""
    known = {r[0] for r in df.where(F.col(column).isin(list(renames))).select(column).distinct().collect()}  # at most as many as renames
    new = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]) if renames else None
    out = df.withColumn(column, F.coalesce(F.try_element_at(new, F.col(column)), F.col(column))) if renames else df
    return out, sorted(set(renames) - known)


def distance_filter(points: DataFrame, plane: tuple[float, float, float, float], lo: float = 0.0, hi: float = 3.0) -> DataFrame:
    """Points whose signed distance to the plane lies from ``lo`` to ``hi``."""
    return points.where(geo.plane_distance(*plane).between(lo, hi))


def hull_meshes(points: DataFrame, planes: DataFrame, keys: list[str], thresh: float) -> tuple[DataFrame, DataFrame]:
    """(vertices: keys, plane, id, x, y, z; triangles: keys, plane, k, a, b, c): the outline of each plane's inliers, as a fan
    about their centroid (vertex 0). ``planes``: keys, plane, a, b, c, d."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    steep = F.abs(c) >= 0.9
    across = [F.when(steep, 0.0).otherwise(b), F.when(steep, c).otherwise(-a), F.when(steep, -b).otherwise(0.0)]
    size = geo.norm(*across)
    based = planes.withColumns({f"u{k}": e / size for k, e in zip("xyz", across, strict=True)})
    ux, uy, uz = F.col("ux"), F.col("uy"), F.col("uz")
    based = based.withColumns({"vx": b * uz - c * uy, "vy": c * ux - a * uz, "vz": a * uy - b * ux})
    near = points.select(*keys, *[F.col(k).cast("double").alias(f"p{k}") for k in "xyz"]).join(based, keys)
    near = near.where(F.abs(geo.plane_distance("a", "b", "c", "d", ("px", "py", "pz"))) < thresh)
    along = lambda s: sum(F.col(f"{s}{k}") * F.col(f"p{k}") for k in "xyz")
    flat = near.select(*keys, "plane", along("u").alias("x"), along("v").alias("y"))
    middle = flat.groupBy(*keys, "plane").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).where("n >= 4")
    rim = materialize(convex_hulls(flat.join(middle.select(*keys, "plane"), [*keys, "plane"], "left_semi"), [*keys, "plane"]), "hulls")
    corners = middle.select(*keys, "plane", F.lit(0).alias("id"), "x", "y").unionByName(rim.select(*keys, "plane", (F.col("k") + 1).alias("id"), "x", "y"))
    lifted = [(F.col("x") * F.col(f"u{k}") + F.col("y") * F.col(f"v{k}") - F.col("d") * F.col(n)).alias(k) for n, k in zip("abc", "xyz", strict=True)]
    vertices = corners.join(based, [*keys, "plane"]).select(*keys, "plane", "id", *lifted)
    sizes = rim.groupBy(*keys, "plane").agg(F.count("*").alias("m"))
    triangles = rim.join(sizes, [*keys, "plane"]).where("m >= 3").select(*keys, "plane", "k", F.lit(0).alias("a"), (F.col("k") + 1).alias("b"), (F.pmod(F.col("k") + 1, F.col("m")) + 1).alias("c"))
    return vertices, triangles


def surface_tiles(points: DataFrame, planes: DataFrame, keys: list[str], thresh: float, step: float = 0.05, half: float = 0.1, least: int = 4) -> DataFrame:
    """keys, plane, i, j, n, mx (how far off the points lie on average), u, v, h, x, y, z and, where points have r, g, b, their weighted colours: a vertex every ``step`` along
    each plane's own axes, lifted by the plane fitted to all points within ``half`` of it (a point counts for every vertex it is
    that near to), or by their mean where the fit fails. ``planes``: keys, plane, a, b, c, d (unit normal)."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    steep = F.abs(c) >= 0.9
    across = [F.when(steep, 0.0).otherwise(b), F.when(steep, c).otherwise(-a), F.when(steep, -b).otherwise(0.0)]
    size = geo.norm(*across)
    based = planes.select(*keys, "plane", "a", "b", "c", "d", *[(e / size).alias(f"u{k}") for k, e in zip("xyz", across, strict=True)])
    ux, uy, uz = F.col("ux"), F.col("uy"), F.col("uz")
    based = based.withColumns({"vx": b * uz - c * uy, "vy": c * ux - a * uz, "vz": a * uy - b * ux})
    rgb = [k for k in "rgb" if k in points.columns]
    near = points.select(*keys, *[F.col(k).cast("double").alias(f"p{k}") for k in "xyz"], *rgb).join(based, keys)
    near = near.withColumn("h", geo.plane_distance("a", "b", "c", "d", ("px", "py", "pz"))).where(F.abs("h") < thresh)
    along = lambda s: sum(F.col(f"{s}{k}") * F.col(f"p{k}") for k in "xyz")
    flat = near.select(*keys, "plane", along("u").alias("pu"), along("v").alias("pv"), F.col("h").alias("z"), *rgb)
    for p, n in (("pu", "i"), ("pv", "j")):
        flat = flat.withColumn(n, F.explode(F.sequence(F.ceil((F.col(p) - half) / step), F.floor((F.col(p) + half) / step))))
    at = flat.select(*keys, "plane", "i", "j", (F.col("pu") - F.col("i") * step).alias("x"), (F.col("pv") - F.col("j") * step).alias("y"), "z", *rgb)
    tile = [*keys, "plane", "i", "j"]
    w = 1 / (F.col("x") * F.col("x") + F.col("y") * F.col("y") + 1e-9)
    extra = at.groupBy(*tile).agg(F.avg("z").alias("mean"), F.avg("x").alias("mx"), *[F.least(F.greatest(F.sum(w * F.col(k)) / F.sum(w), F.lit(0.0)), F.lit(1.0)).alias(k) for k in rgb])
    fits = plane_fit(at, tile, 1e-9).where(F.col("n") >= least).join(extra, tile).withColumn("h", F.coalesce(F.round("c", 9), F.round("mean", 9))).drop("a", "b", "c", "mean")
    u, v, h = F.col("i") * step, F.col("j") * step, F.col("h")
    lifted = [(u * F.col(f"u{k}") + v * F.col(f"v{k}") + (h - F.col("d")) * F.col(n)).alias(k) for n, k in zip("abc", "xyz", strict=True)]
    return fits.join(based, [*keys, "plane"]).select(*tile, "n", "mx", u.alias("u"), v.alias("v"), "h", *lifted, *rgb)


def _moved(points: DataFrame, m: np.ndarray) -> DataFrame:
    return points.select("id", *[e.alias(c) for e, c in zip(geo.rigid([[float(v) for v in row] for row in m]), "xyz", strict=True)])


def register_clouds(points: DataFrame, cloud: str, voxel: float, least_fit: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(transforms: cloud, m (12 numbers), fitness, rms; the merged cloud: id, x, y, z), clouds in order of ``cloud``.

    The first cloud is the frame. Each further one starts from the transform before it and is fitted to all merged so
    far; where less than ``least_fit`` of it matches, it is aligned by features first and the better fit stays.
    Clouds follow one another, so this is a loop of Spark jobs; every cloud is thinned to ``voxel`` before."""
    names = [r[0] for r in points.select(cloud).where(F.col(cloud).isNotNull()).distinct().orderBy(cloud).collect()]
    reaches = (6 * voxel, 3 * voxel, 1.5 * voxel)
    merged, last, out = None, np.eye(4), []
    for name in names:
        one = materialize(thinned(points.where(F.col(cloud) == F.lit(name)).select(F.lit(0).alias("_g"), "x", "y", "z"), ["_g"], voxel).drop("_g"), "cloud")
        fit, rms = 1.0, 0.0
        if merged is not None:
            step, fit, rms = icp(_moved(one, last), merged, reaches)
            now = step @ last
            if fit < least_fit:
                start, _ = global_align(one, merged, voxel)
                step, other, error = icp(_moved(one, start), merged, reaches)
                if other > fit:
                    now, fit, rms = step @ start, other, error
            last = now
        moved = _moved(one, last)
        both = moved if merged is None else merged.unionByName(moved)
        merged = materialize(thinned(both.withColumn("_g", F.lit(0)), ["_g"], voxel).drop("_g"), "merged")
        out.append((name, [float(v) for v in last[:3].ravel()], float(fit), float(rms)))
    kind = points.schema[cloud].dataType.simpleString()
    transforms = points.sparkSession.createDataFrame(out, f"{cloud} {kind}, m array<double>, fitness double, rms double")
    return transforms, thinned(points.limit(0).withColumn("_g", F.lit(0)), ["_g"], voxel).drop("_g") if merged is None else merged


def hole_centers(points: DataFrame, keys: list[str], id: str, hole: float, voxel: float = 0.02, thresh: float = 0.03, least: int = 8) -> DataFrame:
    """keys, hole (smallest id of its rim), n, u, v, r, error, x, y, z: round holes of radius about ``hole`` in the
    main plane of each group. Ids are unique over all groups.

    The plane's inliers are laid flat and thinned to one point per cell; points with an open angle are borders, borders
    linked within three cells form rims, a rim is a hole if its circle is within 0.3 of the radius and its mean
    radial error within a sixth of it. The outer border makes a rim too large to pass."""
    planes = materialize(ransac_planes(points, keys, id, thresh), "planes")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    steep = F.abs(a) > 0.9  # then the second axis is laid across, not the first
    across = [F.when(steep, c).otherwise(0.0), F.when(steep, 0.0).otherwise(-c), F.when(steep, -a).otherwise(b)]
    size = F.greatest(geo.norm(*across), F.lit(1e-12))
    based = planes.withColumns({f"u{k}": e / size for k, e in zip("xyz", across, strict=True)})
    ux, uy, uz = F.col("ux"), F.col("uy"), F.col("uz")
    based = based.withColumns({"vx": b * uz - c * uy, "vy": c * ux - a * uz, "vz": a * uy - b * ux})
    near = points.select(*keys, F.col(id).alias("id"), *[F.col(k).cast("double").alias(f"p{k}") for k in "xyz"]).join(based, keys)
    near = near.where(F.abs(geo.plane_distance("a", "b", "c", "d", ("px", "py", "pz"))) < thresh)
    along = lambda s: sum(F.col(f"{s}{k}") * F.col(f"p{k}") for k in "xyz")
    flat = voxel_first(near.select(*keys, "id", along("u").alias("x"), along("v").alias("y")), keys, voxel, "id", ["x", "y"]).withColumn("z", F.lit(0.0))
    rim = materialize(boundary_points(flat, keys, 2.5 * voxel), "rim")
    links = neighbour_pairs(rim, keys, 3 * voxel).where("a < b").select("a", "b")
    groups = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("hole"))
    rims = rim.join(groups, "id").select(*keys, "hole", "x", "y")
    fits = circle_fit(rims, [*keys, "hole"]).where((F.col("n") >= least) & (F.abs(F.col("r") - hole) <= 0.3 * hole))
    off = F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r"))
    error = rims.join(fits.select(*keys, "hole", "cx", "cy", "r"), [*keys, "hole"]).groupBy(*keys, "hole").agg(F.avg(off).alias("error")).where(F.col("error") <= hole / 6)
    lifted = [(-F.col("d") * F.col(n) + F.col("cx") * F.col(f"u{k}") + F.col("cy") * F.col(f"v{k}")).alias(k) for n, k in zip("abc", "xyz", strict=True)]
    return fits.join(error, [*keys, "hole"]).join(based, keys).select(*keys, "hole", "n", F.col("cx").alias("u"), F.col("cy").alias("v"), "r", "error", *lifted)


def extrinsic(points: DataFrame, targets: DataFrame, pose: str, order: str) -> tuple[list[float], list[float], float, DataFrame]:
    """(rotation by rows, translation, rms, residuals by pose): the one rigid motion that takes the points of all poses
    (pose, order, x, y, z) onto their targets, after pairing within each pose. No common pose is an error."""
    pairs = materialize(correspond_targets(points, targets, pose, order), "pairs")
    fit = rigid_fit(pairs.withColumn("_all", F.lit(0)), ["_all"]).first()
    if fit is None:
        raise ValueError("no pose has as many points as targets")
    return list(fit["r"]), list(fit["t"]), fit["rms"], pose_residuals(pairs, pose, fit["r"], fit["t"])
