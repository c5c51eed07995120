"""Queries over the sensor tables for the operators of the survey, each with equivalent SQL.

Every query counts repeated rows once and runs over whole tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry as geo
from pointloom.operators import features as feat
from pointloom.operators import fit
from pointloom.operators import series as ser
from pointloom.operators import spatial as spa
from pointloom.operators.offsets import offset_by_correlation, offset_by_reversals, offsets_of_pairs, turning_points
from pointloom.operators.percentiles import exact_percentiles
from pointloom.session import materialize, read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PLANES = [
    (0.0, 0.0, 1.0, 0.0, "floor"),
    (0.0, 0.0, -1.0, 12.0, "ceiling"),
    (1.0, 0.0, 0.0, 26.0, "west"),
    (-1.0, 0.0, 0.0, 26.0, "east"),
    (0.0, 1.0, 0.0, 26.0, "south"),
    (0.0, -1.0, 0.0, 26.0, "north"),
]
CAMERA = {"fx": 520.0, "fy": 515.0, "cx": 640.0, "cy": 360.0}
FISHEYE = (-0.012, 0.0031, -0.0011, 0.0002)
EXTRINSIC = [[0.0, -1.0, 0.0, 0.05], [0.0, 0.0, -1.0, -0.08], [1.0, 0.0, 0.0, 0.02]]

PTS = """pts AS (SELECT DISTINCT point_id, frame_id, session_id, point_idx, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, CAST(z AS DOUBLE) z,
 CAST(intensity AS DOUBLE) intensity, ring, point_t FROM pointcloud_points),
ok AS (SELECT * FROM pts WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND NOT (x=0 AND y=0 AND z=0))"""
LID = """lid AS (SELECT DISTINCT lidar_id, session_id, CAST(round(lidar_t*1000000) AS BIGINT) t, lidar_v v, lidar_cx cx, lidar_cy cy, lidar_cz cz
 FROM lidar_signals WHERE lidar_t IS NOT NULL AND isfinite(lidar_t))"""
IMU = """imu AS (SELECT DISTINCT imu_id, session_id, CAST(round(imu_t*1000000) AS BIGINT) t, imu_v v FROM imu_signals
 WHERE imu_t IS NOT NULL AND isfinite(imu_t) AND imu_v IS NOT NULL AND isfinite(imu_v))"""
MSG = "msg AS (SELECT DISTINCT msg_id, session_id, stamp_ns, angular_velocity w, linear_acceleration a FROM imu_messages)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def points(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "pointcloud_points")
    cols = ["point_id", "frame_id", "session_id", "point_idx", "ring", "point_t"]
    return t.select(*cols, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "intensity")]).dropDuplicates(["point_id"])


def good(spark: SparkSession, d: str) -> DataFrame:
    return spa.valid(points(spark, d))


def _us(c: str):
    return F.round(F.col(c) * 1_000_000).cast("bigint")


def lidar(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "lidar_signals").where(geo.finite("lidar_t"))
    return t.select("lidar_id", "session_id", _us("lidar_t").alias("t"), F.col("lidar_v").alias("v"), *[F.col(f"lidar_c{c}").alias(f"c{c}") for c in "xyz"]).dropDuplicates(["lidar_id"])


def imu(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "imu_signals").where(geo.finite("imu_t", "imu_v"))
    return t.select("imu_id", "session_id", _us("imu_t").alias("t"), F.col("imu_v").alias("v")).dropDuplicates(["imu_id"])


def messages(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "imu_messages")
    return t.select("msg_id", "session_id", "stamp_ns", F.col("angular_velocity").alias("w"), F.col("linear_acceleration").alias("a")).dropDuplicates(["msg_id"])


def _r(df: DataFrame, *cols: str, k: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), k) for c in cols})


def _sql_r(cols: str, k: int = 6) -> str:
    return ", ".join(f"round({c}, {k}) AS {c}" for c in cols.split())


# --- projections -----------------------------------------------------------------------------------------


@query("point_projection", f"WITH {PTS} SELECT point_id, x, y, z, intensity/255 AS intensity FROM ok")
def point_projection(spark, d):
    return good(spark, d).select("point_id", "x", "y", "z", (F.col("intensity") / 255).alias("intensity"))


@query("row_layout", f"WITH {PTS}, s AS (SELECT DISTINCT session_id, rig_id FROM sessions) SELECT point_id, point_idx % ring_count AS row, CAST(point_idx // ring_count AS BIGINT) AS col FROM pts JOIN s USING (session_id) JOIN rigs USING (rig_id)")
def row_layout(spark, d):
    h = read_table(spark, d, "sessions").select("session_id", "rig_id").distinct().join(read_table(spark, d, "rigs"), "rig_id").select("session_id", "ring_count")
    p = points(spark, d).join(h, "session_id")
    return p.select("point_id", (F.col("point_idx") % F.col("ring_count")).alias("row"), F.expr("point_idx div ring_count").alias("col"))


@query("stamp_split", f"WITH {MSG} SELECT msg_id, stamp_ns // 1000000000 AS sec, stamp_ns % 1000000000 AS nanosec FROM msg")
def stamp_split(spark, d):
    sec, nano = geo.stamp_split(F.col("stamp_ns"))
    return messages(spark, d).select("msg_id", sec.alias("sec"), nano.alias("nanosec"))


def _sql_rigid(m) -> str:
    return ", ".join(f"({r[0]})*x + ({r[1]})*y + ({r[2]})*z + ({r[3]}) AS {n}" for r, n in zip(m, ("xc", "yc", "zc"), strict=True))


@query("rigid_transform", f"WITH {PTS}, t AS (SELECT point_id, {_sql_rigid(EXTRINSIC)} FROM ok) SELECT point_id, {_sql_r('xc yc zc')} FROM t")
def rigid_transform(spark, d):
    out = geo.rigid(EXTRINSIC)
    return _r(good(spark, d).select("point_id", *[e.alias(n) for e, n in zip(out, ("xc", "yc", "zc"), strict=True)]), "xc", "yc", "zc")


@query("cloud_transforms", f"""WITH {PTS}, f AS (SELECT session_id, frame_id, row_number() OVER (PARTITION BY session_id ORDER BY frame_id) - 1 AS k FROM (SELECT DISTINCT session_id, frame_id FROM pts)),
t AS (SELECT frame_id, k, x*cos(0.01*k) - y*sin(0.01*k) + 0.1*k AS xc, x*sin(0.01*k) + y*cos(0.01*k) - 0.05*k AS yc, z FROM ok JOIN f USING (session_id, frame_id))
SELECT frame_id, k, count(*) AS n, round(avg(xc), 6) AS mx, round(avg(yc), 6) AS my, round(min(xc), 5) AS lo, round(max(yc), 5) AS hi FROM t GROUP BY ALL""")  # fmt: skip
def cloud_transforms(spark, d):
    """A transform per frame, numbered by frame order inside its session (frames, not points, are ordered)."""
    p = good(spark, d)
    frames = read_table(spark, d, "pointcloud_points").select("session_id", "frame_id").distinct()
    k = frames.withColumn("k", (F.row_number().over(Window.partitionBy("session_id").orderBy("frame_id")) - 1).cast("bigint"))
    a = 0.01 * F.col("k")
    m = [[F.cos(a), -F.sin(a), 0.0, 0.1 * F.col("k")], [F.sin(a), F.cos(a), 0.0, -0.05 * F.col("k")], [0.0, 0.0, 1.0, 0.0]]
    x, y, _ = geo.rigid(m)
    t = p.join(k, ["session_id", "frame_id"]).select("frame_id", "k", x.alias("xc"), y.alias("yc"))
    g = t.groupBy("frame_id", "k").agg(F.count("*").alias("n"), F.avg("xc").alias("mx"), F.avg("yc").alias("my"), F.min("xc").alias("lo"), F.max("yc").alias("hi"))
    return _r(_r(g, "mx", "my"), "lo", "hi", k=5)


@query("unit_conversion", f"""WITH {MSG}, s AS (SELECT DISTINCT session_id, rig_id FROM sessions), c AS (SELECT msg_id, CASE imu_unit WHEN 'g' THEN 9.80665 ELSE 1.0 END AS f, a, stamp_ns FROM msg JOIN s USING (session_id) JOIN rigs USING (rig_id))
SELECT msg_id, stamp_ns, round(a.x*f, 6) AS ax, round(a.y*f, 6) AS ay, round(a.z*f, 6) AS az FROM c WHERE a.x IS NOT NULL AND NOT isnan(a.x) AND a.y IS NOT NULL AND NOT isnan(a.y) AND a.z IS NOT NULL AND NOT isnan(a.z)""")  # fmt: skip
def unit_conversion(spark, d):
    unit = read_table(spark, d, "sessions").select("session_id", "rig_id").distinct().join(read_table(spark, d, "rigs"), "rig_id").select("session_id", "imu_unit")
    f = F.when(F.col("imu_unit") == "g", geo.G).otherwise(1.0)
    m = messages(spark, d).where(geo.finite("a.x", "a.y", "a.z")).join(unit, "session_id")
    return _r(m.select("msg_id", "stamp_ns", *[(F.col(f"a.{c}") * f).alias(f"a{c}") for c in "xyz"]), "ax", "ay", "az")


@query("rgb_pack", f"WITH {PTS} SELECT point_id, (CAST(intensity AS INT) << 16) | ((ring % 256) << 8) | (point_idx % 256) AS rgb FROM ok WHERE intensity IS NOT NULL AND isfinite(intensity)")
def rgb_pack(spark, d):
    p = good(spark, d).where(geo.finite("intensity"))
    return p.select("point_id", geo.pack_rgb("intensity", F.col("ring") % 256, F.col("point_idx") % 256).alias("rgb"))


_SQL_FISH = f"""WITH {PTS}, c AS (SELECT point_id, {_sql_rigid(EXTRINSIC)} FROM ok), f AS (SELECT *, sqrt(xc*xc+yc*yc) r, atan2(sqrt(xc*xc+yc*yc), zc) th FROM c WHERE zc > 0.1),
g AS (SELECT *, th*(1+th*th*({FISHEYE[0]}+th*th*({FISHEYE[1]}+th*th*({FISHEYE[2]}+th*th*({FISHEYE[3]}))))) td FROM f),
u AS (SELECT point_id, zc, {CAMERA['fx']}*(CASE WHEN r>1e-12 THEN td/r ELSE 0 END)*xc+{CAMERA['cx']} AS u, {CAMERA['fy']}*(CASE WHEN r>1e-12 THEN td/r ELSE 0 END)*yc+{CAMERA['cy']} AS v FROM g)"""


@query("fisheye_projection", _SQL_FISH + " SELECT point_id, round(u, 5) AS u, round(v, 5) AS v FROM u WHERE u >= 0 AND u < 1280 AND v >= 0 AND v < 720")
def fisheye_projection(spark, d):
    return _r(_seen(spark, d).select("point_id", "u", "v"), "u", "v", k=5)


def _seen(spark, d) -> DataFrame:
    """Points in front of the camera and inside the image."""
    x, y, z = geo.rigid(EXTRINSIC)
    c = good(spark, d).select("point_id", "frame_id", "intensity", x.alias("xc"), y.alias("yc"), z.alias("zc")).where("zc > 0.1")
    u, v = geo.fisheye(("xc", "yc", "zc"), **CAMERA, k=FISHEYE)
    return c.withColumns({"u": u, "v": v}).where("u >= 0 AND u < 1280 AND v >= 0 AND v < 720")


@query("pixel_occupancy", _SQL_FISH + " SELECT CAST(trunc(u) AS INT) AS pu, CAST(trunc(v) AS INT) AS pv, count(*) AS n, round(min(zc), 6) AS depth FROM u WHERE u >= 0 AND u < 1280 AND v >= 0 AND v < 720 GROUP BY 1, 2")
def pixel_occupancy(spark, d):
    """Points by pixel with the nearest depth."""
    p = _seen(spark, d).groupBy(F.col("u").cast("int").alias("pu"), F.col("v").cast("int").alias("pv"))
    return _r(p.agg(F.count("*").alias("n"), F.min("zc").alias("depth")), "depth")


@query("pinhole_projection", f"WITH {PTS}, c AS (SELECT point_id, {_sql_rigid(EXTRINSIC)} FROM ok) SELECT point_id, CAST(round_even({CAMERA['fx']}*xc/zc+{CAMERA['cx']}, 0) AS INT) AS pu, CAST(round_even({CAMERA['fy']}*yc/zc+{CAMERA['cy']}, 0) AS INT) AS pv FROM c WHERE zc > 0.1")
def pinhole_projection(spark, d):
    x, y, z = geo.rigid(EXTRINSIC)
    c = good(spark, d).select("point_id", x.alias("xc"), y.alias("yc"), z.alias("zc")).where("zc > 0.1")
    u, v = geo.pinhole(("xc", "yc", "zc"), **CAMERA)
    return c.select("point_id", F.rint(u).cast("int").alias("pu"), F.rint(v).cast("int").alias("pv"))


def _sql_jet(eps: str) -> str:
    s = f"least(greatest((z-lo)/(hi-lo+{eps}),0),1)"
    return ", ".join(f"round(least(greatest(1.5-abs(4*{s}-{k}),0),1), 6) AS {n}" for k, n in ((3, "r"), (2, "g"), (1, "b")))


@query("jet_percentile", f"WITH {PTS}, q AS (SELECT frame_id, quantile_cont(z, 0.05) lo, quantile_cont(z, 0.95) hi FROM ok GROUP BY 1) SELECT point_id, {_sql_jet('1e-6')} FROM ok JOIN q USING (frame_id)")
def jet_percentile(spark, d):
    p = good(spark, d)
    q = exact_percentiles(p, ["frame_id"], "z", {"lo": 0.05, "hi": 0.95})
    r, g, b = geo.jet(F.col("z"), F.col("lo"), F.col("hi"), 1e-6)
    return _r(p.join(q, "frame_id").select("point_id", r.alias("r"), g.alias("g"), b.alias("b")), "r", "g", "b")


@query("jet_height", f"WITH {PTS}, q AS (SELECT frame_id, min(z) lo, max(z) hi FROM ok GROUP BY 1) SELECT point_id, {_sql_jet('1e-6')} FROM ok JOIN q USING (frame_id)")
def jet_height(spark, d):
    p = good(spark, d)
    q = p.groupBy("frame_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    r, g, b = geo.jet(F.col("z"), F.col("lo"), F.col("hi"), 1e-6)
    return _r(p.join(q, "frame_id").select("point_id", r.alias("r"), g.alias("g"), b.alias("b")), "r", "g", "b")


@query("rainbow_frames", """WITH f AS (SELECT session_id, frame_id, row_number() OVER (PARTITION BY session_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM (SELECT DISTINCT session_id, frame_id FROM pointcloud_points)),
h AS (SELECT frame_id, 6.0*i/n AS h FROM f), s AS (SELECT frame_id, h - floor(h) AS f, CAST(floor(h) AS INT) % 6 AS s FROM h)
SELECT frame_id, round(CASE s WHEN 0 THEN 1.0 WHEN 1 THEN 1-f WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 WHEN 4 THEN f ELSE 1.0 END, 6) AS r,
round(CASE s WHEN 0 THEN f WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1-f ELSE 0.0 END, 6) AS g,
round(CASE s WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN f WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 ELSE 1-f END, 6) AS b FROM s""")  # fmt: skip
def rainbow_frames(spark, d):
    f = read_table(spark, d, "pointcloud_points").select("session_id", "frame_id").distinct()
    w = Window.partitionBy("session_id")
    f = f.withColumn("i", F.row_number().over(w.orderBy("frame_id")) - 1).withColumn("n", F.count("*").over(w))
    r, g, b = geo.rainbow(F.col("i"), F.col("n"))
    return _r(f.select("frame_id", r.alias("r"), g.alias("g"), b.alias("b")), "r", "g", "b")


_SQL_NEAR = "CASE least(" + ", ".join(f"abs(({p[0]})*x+({p[1]})*y+({p[2]})*z+({p[3]}))" for p in PLANES) + ") " + " ".join(f"WHEN abs(({p[0]})*x+({p[1]})*y+({p[2]})*z+({p[3]})) THEN {i}" for i, p in enumerate(PLANES)) + " END"
_SQL_DIST = "least(" + ", ".join(f"abs(({p[0]})*x+({p[1]})*y+({p[2]})*z+({p[3]}))" for p in PLANES) + ")"
_SQL_PLANES = "pl(plane, label) AS (VALUES " + ", ".join(f"({i}, '{p[4]}')" for i, p in enumerate(PLANES)) + ")"


@query("plane_summary", f"""WITH {PTS}, {_SQL_PLANES}, n AS (SELECT frame_id, CASE WHEN {_SQL_DIST} < 0.5 THEN {_SQL_NEAR} ELSE -1 END AS plane, {_SQL_DIST} AS dist FROM ok)
SELECT frame_id, n.plane, coalesce(label, 'unassigned') AS label, count(*) AS n, round(min(dist), 6) AS dmin, round(max(dist), 6) AS dmax, round(avg(dist), 6) AS dmean, round(stddev_pop(dist), 6) AS dstd
FROM n LEFT JOIN pl ON n.plane = pl.plane GROUP BY ALL""")  # fmt: skip
def plane_summary(spark, d):
    """Nearest plane of every point (beyond 0.5 m: -1), then counts and distance figures per frame and plane.
    The planes are literals: no join for the assignment, one aggregate that is combined before its shuffle."""
    near = good(spark, d).select("frame_id", geo.nearest_plane(PLANES).alias("m")).select("frame_id", F.when(F.col("m.d") < 0.5, F.col("m.i")).otherwise(-1).alias("plane"), F.col("m.d").alias("dist"))
    labels = F.create_map(*[F.lit(v) for i, p in enumerate(PLANES) for v in (i, p[4])])
    g = near.groupBy("frame_id", "plane").agg(F.count("*").alias("n"), F.min("dist").alias("dmin"), F.max("dist").alias("dmax"), F.avg("dist").alias("dmean"), F.stddev_pop("dist").alias("dstd"))
    return _r(g.withColumn("label", F.when(F.col("plane") < 0, "unassigned").otherwise(F.try_element_at(labels, F.col("plane")))), "dmin", "dmax", "dmean", "dstd")


@query("plane_band", f"WITH {PTS} SELECT point_id, round(z, 6) AS dist FROM ok WHERE z >= 0.5 AND z <= 3.0")
def plane_band(spark, d):
    p = good(spark, d).withColumn("dist", geo.plane_distance(*PLANES[0][:4]))
    return _r(p.where(F.col("dist").between(0.5, 3.0)).select("point_id", "dist"), "dist")


@query("plane_inliers", f"WITH {PTS}, n AS (SELECT frame_id, {', '.join(f'abs(({p[0]})*x+({p[1]})*y+({p[2]})*z+({p[3]})) < 0.05 AS i{i}' for i, p in enumerate(PLANES))} FROM ok) SELECT frame_id, {', '.join(f'count(*) FILTER (i{i}) AS n_{p[4]}' for i, p in enumerate(PLANES))} FROM n GROUP BY 1")
def plane_inliers(spark, d):
    p = good(spark, d)
    return p.groupBy("frame_id").agg(*[F.count_if(F.abs(geo.plane_distance(*pl[:4])) < 0.05).alias(f"n_{pl[4]}") for pl in PLANES])


@query("plane_peel", f"""WITH {PTS}, a AS (SELECT * FROM ok WHERE z >= 0.05), b AS (SELECT * FROM a WHERE 12 - z >= 0.05), c AS (SELECT * FROM b WHERE abs(x + 26) >= 0.05)
SELECT frame_id, count(*) AS remaining FROM c GROUP BY 1""")  # fmt: skip
def plane_peel(spark, d):
    """Inliers of one plane after the other are taken away; what remains is counted."""
    rest = good(spark, d)
    for pl in PLANES[:3]:
        rest = rest.where(~(F.abs(geo.plane_distance(*pl[:4])) < 0.05))
    return rest.groupBy("frame_id").agg(F.count("*").alias("remaining"))


_SQL_FIT = """f AS (SELECT frame_id, count(*) n, sum(x) sx, sum(y) sy, sum(z) sz, sum(x*x) sxx, sum(x*y) sxy, sum(y*y) syy, sum(x*z) sxz, sum(y*z) syz FROM ok GROUP BY 1),
d AS (SELECT *, sxx*(syy*n-sy*sy) - sxy*(sxy*n-sy*sx) + sx*(sxy*sy-syy*sx) AS det FROM f),
p AS (SELECT frame_id, n, (sxz*(syy*n-sy*sy) - sxy*(syz*n-sy*sz) + sx*(syz*sy-syy*sz))/det AS a,
 (sxx*(syz*n-sz*sy) - sxz*(sxy*n-sy*sx) + sx*(sxy*sz-syz*sx))/det AS b, (sxx*(syy*sz-syz*sy) - sxy*(sxy*sz-syz*sx) + sxz*(sxy*sy-syy*sx))/det AS c FROM d WHERE abs(det) > 1e-6 AND n >= 20)"""


@query("plane_least_squares", f"WITH {PTS}, {_SQL_FIT} SELECT frame_id, n, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM p")
def plane_least_squares(spark, d):
    f = spa.plane_fit(good(spark, d), ["frame_id"], 1e-6).where("a IS NOT NULL AND n >= 20")
    return _r(f, "a", "b", "c", k=4)


@query("plane_lines", f"""WITH {PTS}, {_SQL_FIT}, s AS (SELECT DISTINCT session_id, frame_id FROM ok), q AS (SELECT session_id, frame_id, a, b, c, lead(frame_id) OVER w AS other, lead(a) OVER w AS a2, lead(b) OVER w AS b2, lead(c) OVER w AS c2 FROM p JOIN s USING (frame_id) WINDOW w AS (PARTITION BY session_id ORDER BY frame_id)),
k AS (SELECT frame_id, other, b2 - b AS dx, a - a2 AS dy, a*b2 - b*a2 AS dz FROM q WHERE other IS NOT NULL)
SELECT frame_id, other, CASE WHEN sqrt(dx*dx+dy*dy+dz*dz) < 1e-6 THEN NULL ELSE round(abs(dx)/sqrt(dx*dx+dy*dy+dz*dz), 3) END AS ux FROM k""")  # fmt: skip
def plane_lines(spark, d):
    """Direction of the line in which the fitted planes of successive frames meet; null where they are parallel."""
    p = good(spark, d)
    f = spa.plane_fit(p, ["frame_id"], 1e-6).where("a IS NOT NULL AND n >= 20").join(p.select("session_id", "frame_id").distinct(), "frame_id")
    w = Window.partitionBy("session_id").orderBy("frame_id")
    q = f.select("frame_id", "a", "b", F.lead("frame_id").over(w).alias("other"), F.lead("a").over(w).alias("a2"), F.lead("b").over(w).alias("b2")).where("other IS NOT NULL")
    dx, dy, dz = F.col("b2") - F.col("b"), F.col("a") - F.col("a2"), F.col("a") * F.col("b2") - F.col("b") * F.col("a2")
    size = geo.norm(dx, dy, dz)
    return q.select("frame_id", "other", F.when(size >= 1e-6, F.round(F.abs(dx) / F.when(size >= 1e-6, size), 3)).alias("ux"))


@query("line_snap", f"WITH {PTS}, l AS (SELECT point_id, x, y, z, sqrt((x-26)*(x-26)+(y-26)*(y-26)) AS r FROM ok) SELECT point_id, CASE WHEN r < 1.5 THEN 26.0 ELSE x END AS x, CASE WHEN r < 1.5 THEN 26.0 ELSE y END AS y, round(r, 6) AS r FROM l")
def line_snap(spark, d):
    """Points within 1.5 m of the room's vertical corner edge are moved onto it."""
    r = F.sqrt((F.col("x") - 26) * (F.col("x") - 26) + (F.col("y") - 26) * (F.col("y") - 26))
    p = good(spark, d).withColumn("r", r)
    snap = lambda c: F.when(F.col("r") < 1.5, F.lit(26.0)).otherwise(F.col(c)).alias(c)
    return _r(p.select("point_id", snap("x"), snap("y"), "r"), "r")


@query("euler_angles", f"WITH {MSG} SELECT msg_id, round(degrees(w.x), 5) AS rx, round(degrees(w.y), 5) AS ry, round(degrees(w.z), 5) AS rz FROM msg WHERE w.x IS NOT NULL AND w.y IS NOT NULL AND w.z IS NOT NULL AND isfinite(w.x) AND isfinite(w.y) AND isfinite(w.z) AND abs(w.x) < 1.5 AND abs(w.y) < 1.5 AND abs(w.z) < 1.5")
def euler_angles(spark, d):
    """Angular rates read as small angles, made a rotation matrix and taken apart again."""
    m = messages(spark, d).where(geo.finite("w.x", "w.y", "w.z") & (F.abs("w.x") < 1.5) & (F.abs("w.y") < 1.5) & (F.abs("w.z") < 1.5))
    (a, b, c), (s, t, u) = [F.cos(f"w.{k}") for k in "xyz"], [F.sin(f"w.{k}") for k in "xyz"]
    r = [[c * b, c * t * s - u * a, c * t * a + u * s], [u * b, u * t * s + c * a, u * t * a - c * s], [-t, b * s, b * a]]
    return _r(m.select("msg_id", *[e.alias(n) for e, n in zip(geo.euler_xyz(r), ("rx", "ry", "rz"), strict=True)]), "rx", "ry", "rz", k=5)


@query("dominant_axis", f"""WITH {MSG}, g AS (SELECT session_id, avg(a.x) mx, avg(a.y) my, avg(a.z) mz FROM msg WHERE isfinite(a.x) AND isfinite(a.y) AND isfinite(a.z) GROUP BY 1)
SELECT session_id, CASE greatest(abs(mx),abs(my),abs(mz)) WHEN abs(mx) THEN (CASE WHEN mx>=0 THEN '+x' ELSE '-x' END) WHEN abs(my) THEN (CASE WHEN my>=0 THEN '+y' ELSE '-y' END) ELSE (CASE WHEN mz>=0 THEN '+z' ELSE '-z' END) END AS axis FROM g""")  # fmt: skip
def dominant_axis(spark, d):
    g = messages(spark, d).where(geo.finite("a.x", "a.y", "a.z")).groupBy("session_id").agg(*[F.avg(f"a.{c}").alias(f"m{c}") for c in "xyz"])
    return g.select("session_id", geo.dominant_axis("mx", "my", "mz").alias("axis"))


@query("label_colors", f"WITH {PTS} SELECT point_id, CASE WHEN intensity IS NULL OR isnan(intensity) THEN 'gray' WHEN intensity >= 128 THEN 'bright' ELSE 'c' || CAST(ring % 5 AS VARCHAR) END AS color FROM ok")
def label_colors(spark, d):
    """A name for bright returns, else one of five by ring; gray where there is no intensity."""
    none = ~geo.finite("intensity")
    c = F.when(none, "gray").when(F.col("intensity") >= 128, "bright").otherwise(F.concat(F.lit("c"), (F.col("ring") % 5).cast("string")))
    return good(spark, d).select("point_id", c.alias("color"))


@query("label_rename", "SELECT session_id, CASE operator_note WHEN 'battery low' THEN 'power' WHEN 'rerun' THEN 'repeat' ELSE coalesce(operator_note, 'none') END AS label FROM (SELECT DISTINCT session_id, operator_note FROM sessions)")
def label_rename(spark, d):
    s = read_table(spark, d, "sessions").select("session_id", "operator_note").distinct()
    new = spark.createDataFrame([("battery low", "power"), ("rerun", "repeat")], "operator_note string, new string")
    return s.join(F.broadcast(new), "operator_note", "left").select("session_id", F.coalesce("new", "operator_note", F.lit("none")).alias("label"))


@query("marker_corners", f"""WITH {PTS}, c AS (SELECT frame_id, avg(x) x, avg(y) y FROM ok GROUP BY 1)
SELECT frame_id, k AS corner, round(x + dx, 6) AS x, round(y + dy, 6) AS y FROM c CROSS JOIN (VALUES (0, -0.5, 0.5), (1, 0.5, 0.5), (2, 0.5, -0.5), (3, -0.5, -0.5)) o(k, dx, dy)""")  # fmt: skip
def marker_corners(spark, d):
    """Corners of a one metre square about each frame's centroid: top left, top right, bottom right, bottom left."""
    c = good(spark, d).groupBy("frame_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    corners = F.array(*[F.struct((F.col("cx") + a).alias("x"), (F.col("cy") + b).alias("y")) for a, b in ((-0.5, 0.5), (0.5, 0.5), (0.5, -0.5), (-0.5, -0.5))])
    return _r(c.select("frame_id", F.posexplode(corners).alias("corner", "p")).select("frame_id", "corner", "p.x", "p.y"), "x", "y")


# --- filters and sets ------------------------------------------------------------------------------------


@query("range_gate", f"WITH {PTS}, s AS (SELECT DISTINCT session_id, rig_id FROM sessions) SELECT point_id FROM pts JOIN s USING (session_id) JOIN rigs USING (rig_id) WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND sqrt(x*x+y*y+z*z) BETWEEN min_distance AND max_distance")
def range_gate(spark, d):
    lim = read_table(spark, d, "sessions").select("session_id", "rig_id").distinct().join(read_table(spark, d, "rigs"), "rig_id").select("session_id", "min_distance", "max_distance")
    p = points(spark, d).where(geo.finite("x", "y", "z")).join(lim, "session_id")
    return p.where(geo.range_gate("min_distance", "max_distance")).select("point_id")


@query("azimuth_gate", f"WITH {PTS}, a AS (SELECT point_id, degrees(atan2(y, x)) AS a FROM ok), b AS (SELECT point_id, CASE WHEN a < 0 THEN a + 360 ELSE a END AS a FROM a) SELECT point_id FROM b WHERE a >= 300 OR a <= 45")
def azimuth_gate(spark, d):
    return good(spark, d).where(geo.azimuth_gate(300, 45)).select("point_id")


@query("finite_counts", f"WITH {PTS} SELECT frame_id, count(*) AS n, count(*) FILTER (isfinite(x) AND isfinite(y) AND isfinite(z)) AS finite, count(*) FILTER (isfinite(x) AND isfinite(y) AND isfinite(z) AND NOT (x=0 AND y=0 AND z=0)) AS valid FROM pts GROUP BY 1")
def finite_counts(spark, d):
    ok = geo.finite("x", "y", "z")
    zero = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
    return points(spark, d).groupBy("frame_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("finite"), F.count_if(ok & ~zero).alias("valid"))


@query("box_crop", f"WITH {PTS} SELECT point_id FROM pts WHERE x BETWEEN -10 AND 10 AND y BETWEEN -5 AND 20 AND z BETWEEN 0.2 AND 4")
def box_crop(spark, d):
    return points(spark, d).where(geo.inside_box((-10, -5, 0.2), (10, 20, 4))).select("point_id")


@query("probes_kept", f"WITH {PTS} SELECT o.point_id, CASE WHEN k.point_id IS NULL THEN 'rest' ELSE 'chosen' END AS side FROM ok o LEFT JOIN (SELECT DISTINCT point_id FROM knn_probes) k USING (point_id)")
def probes_kept(spark, d):
    """Selection by id and its inverse: semi and anti join, put together again."""
    p, k = good(spark, d), read_table(spark, d, "knn_probes").select("point_id").distinct()
    return p.join(k, "point_id", "left_semi").select("point_id", F.lit("chosen").alias("side")).unionByName(p.join(k, "point_id", "left_anti").select("point_id", F.lit("rest").alias("side")))


@query("known_rigs", """SELECT session_id, rig_id, lidar_type FROM (SELECT DISTINCT session_id, rig_id FROM sessions) JOIN rigs USING (rig_id) WHERE firmware IS NOT NULL AND rig_id IN (SELECT rig_id FROM sessions GROUP BY 1 HAVING count(DISTINCT session_id) >= 2)""")
def known_rigs(spark, d):
    """Sessions of rigs with known firmware that have at least two sessions."""
    s = read_table(spark, d, "sessions").select("session_id", "rig_id").distinct()
    many = s.groupBy("rig_id").agg(F.count("*").alias("n")).where("n >= 2")
    rigs = read_table(spark, d, "rigs").where("firmware IS NOT NULL").select("rig_id", "lidar_type")
    return s.join(rigs, "rig_id").join(many, "rig_id", "left_semi").select("session_id", "rig_id", "lidar_type")


@query("session_routing", "SELECT session_kind, count(DISTINCT session_id) AS sessions, count(DISTINCT rig_id) AS rigs FROM sessions GROUP BY 1")
def session_routing(spark, d):
    return read_table(spark, d, "sessions").groupBy("session_kind").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("rig_id").alias("rigs"))


@query("union_signals", f"WITH {LID}, {IMU} SELECT session_id, 'lidar' AS sensor, count(*) AS n FROM lid GROUP BY 1 UNION ALL SELECT session_id, 'imu', count(*) FROM imu GROUP BY 1")
def union_signals(spark, d):
    both = lidar(spark, d).select("session_id", F.lit("lidar").alias("sensor"), "v").unionByName(imu(spark, d).select("session_id", F.lit("imu").alias("sensor"), "v"))
    return both.groupBy("session_id", "sensor").agg(F.count("*").alias("n"))


@query("common_sessions", "SELECT DISTINCT session_id FROM lidar_signals INTERSECT SELECT DISTINCT session_id FROM imu_signals")
def common_sessions(spark, d):
    return read_table(spark, d, "lidar_signals").select("session_id").intersect(read_table(spark, d, "imu_signals").select("session_id"))


@query("sessions_without_points", "SELECT DISTINCT session_id FROM sessions EXCEPT SELECT DISTINCT session_id FROM pointcloud_points")
def sessions_without_points(spark, d):
    return read_table(spark, d, "sessions").select("session_id").subtract(read_table(spark, d, "pointcloud_points").select("session_id"))


@query("clip_frames", f"WITH {PTS} SELECT frame_id, point_id FROM (SELECT frame_id, point_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx, point_id) AS r FROM pts) WHERE r <= 100")
def clip_frames(spark, d):
    """The first 100 points of every frame (the operator's purpose is the limit)."""
    p = points(spark, d).select("frame_id", "point_id", F.struct("point_idx", "point_id").alias("o"))
    return spa.first_n(p, ["frame_id"], "o", 100).select("frame_id", "point_id")


@query("pad_frames", f"""WITH {PTS}, n AS (SELECT frame_id, count(*) AS n FROM pts GROUP BY 1), m AS (SELECT max(n) AS most FROM n)
SELECT frame_id, n AS present, most - n AS padded FROM n, m""")  # fmt: skip
def pad_frames(spark, d):
    """How many zero points each frame needs to be as large as the largest."""
    n = points(spark, d).groupBy("frame_id").agg(F.count("*").alias("present"))
    return n.select("frame_id", "present", (n.agg(F.max("present")).scalar() - F.col("present")).alias("padded"))


# --- aggregates ------------------------------------------------------------------------------------------


@query("box_summary", f"WITH {PTS} SELECT frame_id, {', '.join(f'min({c}) AS {c}_min, max({c}) AS {c}_max, round(max({c})-min({c}), 6) AS {c}_span' for c in 'xyz')} FROM ok GROUP BY 1")
def box_summary(spark, d):
    g = good(spark, d).groupBy("frame_id")
    return g.agg(*[e for c in "xyz" for e in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.round(F.max(c) - F.min(c), 6).alias(f"{c}_span"))])


@query("variance_axis", f"""WITH {MSG}, g AS (SELECT session_id, var_pop(a.x) vx, var_pop(a.y) vy, var_pop(a.z) vz FROM msg WHERE isfinite(a.x) AND isfinite(a.y) AND isfinite(a.z) GROUP BY 1)
SELECT session_id, CASE greatest(vx, vy, vz) WHEN vx THEN 'x' WHEN vy THEN 'y' ELSE 'z' END AS axis, round(greatest(vx, vy, vz), 6) AS var FROM g""")  # fmt: skip
def variance_axis(spark, d):
    g = messages(spark, d).where(geo.finite("a.x", "a.y", "a.z")).groupBy("session_id").agg(*[F.var_pop(f"a.{c}").alias(f"v{c}") for c in "xyz"])
    m = F.greatest("vx", "vy", "vz")
    return g.select("session_id", F.when(F.col("vx") == m, "x").when(F.col("vy") == m, "y").otherwise("z").alias("axis"), F.round(m, 6).alias("var"))


@query("percentiles", f"WITH {PTS} SELECT frame_id, round(quantile_cont(z, 0.02), 6) AS p02, round(quantile_cont(z, 0.5), 6) AS p50, round(quantile_cont(z, 0.98), 6) AS p98 FROM ok GROUP BY 1")
def percentiles(spark, d):
    return _r(exact_percentiles(good(spark, d), ["frame_id"], "z", {"p02": 0.02, "p50": 0.5, "p98": 0.98}), "p02", "p50", "p98")


@query("centroids", f"WITH {PTS} SELECT session_id, frame_id, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM ok GROUP BY 1, 2 HAVING count(*) >= 30")
def centroids(spark, d):
    g = good(spark, d).groupBy("session_id", "frame_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"]).where("n >= 30")
    return _r(g, "cx", "cy", "cz")


@query("voxel_mean", f"WITH {PTS} SELECT frame_id, CAST(floor(x/0.5) AS BIGINT) AS vx, CAST(floor(y/0.5) AS BIGINT) AS vy, CAST(floor(z/0.5) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM ok GROUP BY 1, 2, 3, 4")
def voxel_mean(spark, d):
    return _r(spa.voxel_mean(good(spark, d), ["frame_id"], 0.5, ["x", "y", "z"]), "x", "y", "z")


@query("voxel_first", f"WITH {PTS} SELECT frame_id, CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, min(point_id) AS point_id FROM ok GROUP BY 1, 2, 3")
def voxel_first(spark, d):
    return spa.voxel_first(good(spark, d), ["frame_id"], 1.0, "point_id", [])


@query("occupied_cells", f"WITH {PTS} SELECT session_id, count(*) AS cells FROM (SELECT DISTINCT session_id, floor(x*4), floor(y*4), floor(z*4) FROM ok) GROUP BY 1")
def occupied_cells(spark, d):
    c = good(spark, d).select("session_id", *[spa.cell(k, 0.25).alias(f"c{k}") for k in "xyz"]).distinct()
    return c.groupBy("session_id").agg(F.count("*").alias("cells"))


_SQL_TILES = f"""{PTS}, t AS (SELECT frame_id, CAST(floor(x/2) AS BIGINT) AS i, CAST(floor(y/2) AS BIGINT) AS j, x - (floor(x/2)*2 + 1) AS dx, y - (floor(y/2)*2 + 1) AS dy, z FROM ok),
f AS (SELECT frame_id, i, j, count(*) n, sum(dx) sx, sum(dy) sy, sum(z) sz, sum(dx*dx) sxx, sum(dx*dy) sxy, sum(dy*dy) syy, sum(dx*z) sxz, sum(dy*z) syz FROM t GROUP BY 1, 2, 3 HAVING count(*) >= 8),
e AS (SELECT *, sxx*(syy*n-sy*sy) - sxy*(sxy*n-sy*sx) + sx*(sxy*sy-syy*sx) AS det FROM f),
g AS (SELECT frame_id, i, j, n, CASE WHEN abs(det) > 1e-6 THEN (sxx*(syy*sz-syz*sy) - sxy*(sxy*sz-syz*sx) + sxz*(sxy*sy-syy*sx))/det ELSE sz/n END AS h FROM e)"""


@query("tile_heights", f"WITH {_SQL_TILES} SELECT frame_id, i, j, n, round(h, 4) AS h FROM g")
def tile_heights(spark, d):
    """Height at the middle of each 2 m tile from a plane through its points; their mean where the fit fails."""
    return _r(_tiles(spark, d).select("frame_id", "i", "j", "n", "h"), "h", k=4)


def _tiles(spark, d) -> DataFrame:
    i, j = spa.cell("x", 2.0), spa.cell("y", 2.0)
    t = good(spark, d).select("frame_id", i.alias("i"), j.alias("j"), (F.col("x") - (i * 2 + 1)).alias("x"), (F.col("y") - (j * 2 + 1)).alias("y"), "z")
    keys = ["frame_id", "i", "j"]
    mean = t.groupBy(*keys).agg(F.avg("z").alias("mean"))
    return spa.plane_fit(t, keys, 1e-6).where("n >= 8").join(mean, keys).withColumn("h", F.coalesce("c", "mean"))


@query("tile_triangles", f"""WITH {_SQL_TILES},
q AS (SELECT p.frame_id, p.i, p.j, p.h hp, q.h hq, r.h hr, s.h hs FROM g p JOIN g q ON q.frame_id=p.frame_id AND q.i=p.i+1 AND q.j=p.j JOIN g r ON r.frame_id=p.frame_id AND r.i=p.i AND r.j=p.j+1 JOIN g s ON s.frame_id=p.frame_id AND s.i=p.i+1 AND s.j=p.j+1),
k AS (SELECT frame_id, i, j, 0 AS half, greatest(sqrt(4+(hp-hq)*(hp-hq)), sqrt(4+(hq-hs)*(hq-hs)), sqrt(8+(hp-hs)*(hp-hs))) AS longest FROM q
UNION ALL SELECT frame_id, i, j, 1, greatest(sqrt(8+(hp-hs)*(hp-hs)), sqrt(4+(hs-hr)*(hs-hr)), sqrt(4+(hp-hr)*(hp-hr))) FROM q)
SELECT frame_id, i, j, half, round(longest, 4) AS longest FROM k WHERE longest < 4.0""")  # fmt: skip
def tile_triangles(spark, d):
    """Mesh of the tile heights: neighbours in the grid joined, long triangles left out."""
    g = _tiles(spark, d).select("frame_id", "i", "j", (F.col("i") * 2.0 + 1).alias("x"), (F.col("j") * 2.0 + 1).alias("y"), F.col("h").alias("z"))
    return _r(spa.triangles(g, ["frame_id"], 4.0), "longest", k=4)


@query("idw_intensity", f"""WITH {PTS}, t AS (SELECT frame_id, CAST(floor(x/2) AS BIGINT) AS i, CAST(floor(y/2) AS BIGINT) AS j, 1/((x-(floor(x/2)*2+1))*(x-(floor(x/2)*2+1)) + (y-(floor(y/2)*2+1))*(y-(floor(y/2)*2+1)) + 1e-9) AS w, intensity AS c FROM ok WHERE intensity IS NOT NULL AND isfinite(intensity))
SELECT frame_id, i, j, round(sum(w*c)/sum(w), 4) AS c FROM t GROUP BY 1, 2, 3""")  # fmt: skip
def idw_intensity(spark, d):
    """Intensity at tile middles, weighted by inverse squared distance."""
    i, j = spa.cell("x", 2.0), spa.cell("y", 2.0)
    dx, dy = F.col("x") - (i * 2 + 1), F.col("y") - (j * 2 + 1)
    t = good(spark, d).where(geo.finite("intensity")).select("frame_id", i.alias("i"), j.alias("j"), (1 / (dx * dx + dy * dy + 1e-9)).alias("w"), F.col("intensity").alias("c"))
    return _r(t.groupBy("frame_id", "i", "j").agg((F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("c")), "c", k=4)


@query("circle_fits", f"""WITH {PTS}, f AS (SELECT frame_id, count(*) n, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(x*y) sxy, sum(y*y) syy, sum(x*x+y*y) sz, sum(x*(x*x+y*y)) sxz, sum(y*(x*x+y*y)) syz FROM ok GROUP BY 1),
d AS (SELECT *, sxx*(syy*n-sy*sy) - sxy*(sxy*n-sy*sx) + sx*(sxy*sy-syy*sx) AS det FROM f),
p AS (SELECT frame_id, n, (sxz*(syy*n-sy*sy) - sxy*(syz*n-sy*sz) + sx*(syz*sy-syy*sz))/det AS a,
 (sxx*(syz*n-sz*sy) - sxz*(sxy*n-sy*sx) + sx*(sxy*sz-syz*sx))/det AS b, (sxx*(syy*sz-syz*sy) - sxy*(sxy*sz-syz*sx) + sxz*(sxy*sy-syy*sx))/det AS c FROM d WHERE abs(det) > 1e-9 AND n >= 20)
SELECT frame_id, n, round(a/2, 4) AS cx, round(b/2, 4) AS cy, round(sqrt(c + a*a/4 + b*b/4), 4) AS r FROM p WHERE c + a*a/4 + b*b/4 > 0 AND abs(sqrt(c + a*a/4 + b*b/4) - 20) <= 6""")  # fmt: skip
def circle_fits(spark, d):
    """Circle through each frame's x, y, kept where the radius is plausible (20 m ± 30 %)."""
    f = spa.circle_fit(good(spark, d), ["frame_id"]).where("r IS NOT NULL AND n >= 20 AND abs(r - 20) <= 6")
    return _r(f, "cx", "cy", "r", k=4)


@query("ring_features", f"WITH {PTS} SELECT frame_id, ring, count(*) AS n, round(avg(x), 6) AS u, round(avg(y), 6) AS v, round(sqrt(avg(x*x+y*y)), 6) AS rms, round(max(x)-min(x), 6) AS width FROM ok GROUP BY 1, 2")
def ring_features(spark, d):
    g = good(spark, d).groupBy("frame_id", "ring")
    x, y = F.col("x"), F.col("y")
    return _r(g.agg(F.count("*").alias("n"), F.avg("x").alias("u"), F.avg("y").alias("v"), F.sqrt(F.avg(x * x + y * y)).alias("rms"), (F.max("x") - F.min("x")).alias("width")), "u", "v", "rms", "width")


@query("fitness", f"WITH {PTS}, n AS (SELECT frame_id, {_SQL_DIST} AS d FROM ok) SELECT frame_id, round(count(*) FILTER (d < 0.3) / count(*), 6) AS fitness, round(sqrt(avg(d*d) FILTER (d < 0.3)), 6) AS rmse, count(*) FILTER (d < 0.3) * 1.0 / count(*) < 0.3 AS warn FROM n GROUP BY 1")
def fitness(spark, d):
    """Share of points within 0.3 m of a plane and their root mean square distance."""
    n = good(spark, d).select("frame_id", geo.nearest_plane(PLANES)["d"].alias("dd"))
    near = F.col("dd") < 0.3
    g = n.groupBy("frame_id").agg((F.count_if(near) / F.count("*")).alias("fitness"), F.sqrt(F.avg(F.when(near, F.col("dd") * F.col("dd")))).alias("rmse"))
    return _r(g.withColumn("warn", F.col("fitness") < 0.3), "fitness", "rmse")


@query("radius_neighbors", f"WITH {PTS} SELECT p.frame_id, p.point_id, count(*) - 1 AS neighbours FROM ok p JOIN ok q ON p.frame_id = q.frame_id AND abs(p.x-q.x) <= 0.2 AND abs(p.y-q.y) <= 0.2 AND abs(p.z-q.z) <= 0.2 AND (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z) <= 0.2*0.2 GROUP BY 1, 2")
def radius_neighbors(spark, d):
    return spa.radius_counts(good(spark, d), ["frame_id"], "point_id", 0.2)


@query("channel_ranking", f"""WITH {MSG}, u AS (SELECT session_id, unnest(['ax','ay','az','wx','wy','wz']) AS channel, unnest([a.x,a.y,a.z,w.x,w.y,w.z]) AS v FROM msg), s AS (SELECT session_id, channel, stddev_pop(v) AS s FROM u WHERE v IS NOT NULL AND isfinite(v) GROUP BY 1, 2)
SELECT session_id, channel, round(s, 6) AS std, row_number() OVER (PARTITION BY session_id ORDER BY round(s, 6) DESC, channel) AS place FROM s""")  # fmt: skip
def channel_ranking(spark, d):
    cols = [F.struct(F.lit(f"{k}{c}").alias("channel"), F.col(f"{k}.{c}").alias("v")) for k in "aw" for c in "xyz"]
    u = messages(spark, d).select("session_id", F.explode(F.array(*cols)).alias("u")).select("session_id", "u.*").where(geo.finite("v"))
    s = u.groupBy("session_id", "channel").agg(F.round(F.stddev_pop("v"), 6).alias("std"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("std"), "channel")).cast("bigint"))


@query("nan_range", "SELECT session_id, min(lidar_v) FILTER (NOT isnan(lidar_v)) AS lo, max(lidar_v) FILTER (NOT isnan(lidar_v)) AS hi, count(DISTINCT lidar_id) AS n FROM lidar_signals GROUP BY 1")
def nan_range(spark, d):
    v = F.when(~F.isnan("lidar_v"), F.col("lidar_v"))
    return read_table(spark, d, "lidar_signals").groupBy("session_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.countDistinct("lidar_id").alias("n"))


# --- series ----------------------------------------------------------------------------------------------

VAL = "val AS (SELECT * FROM lid WHERE v IS NOT NULL AND isfinite(v))"


def _valued(spark, d) -> DataFrame:
    return ser.row_index(lidar(spark, d).where(geo.finite("v")), ["session_id"], "t", "lidar_id")


@query("zero_base", f"WITH {LID} SELECT lidar_id, t - min(t) OVER (PARTITION BY session_id) AS rel FROM lid")
def zero_base(spark, d):
    t = lidar(spark, d)
    return t.join(t.groupBy("session_id").agg(F.min("t").alias("t0")), "session_id").select("lidar_id", (F.col("t") - F.col("t0")).alias("rel"))


@query("epoch_removal", "SELECT session_id, round(coalesce(c.t0 - l.t0, 0), 6) AS epoch FROM (SELECT DISTINCT session_id FROM sessions WHERE session_kind = 'sync') s LEFT JOIN (SELECT session_id, min(cam_t) t0 FROM cam_signals WHERE isfinite(cam_t) GROUP BY 1) c USING (session_id) LEFT JOIN (SELECT session_id, min(lidar_t) t0 FROM lidar_signals WHERE isfinite(lidar_t) GROUP BY 1) l USING (session_id)")
def epoch_removal(spark, d):
    """Offset of the first camera stamp to the first range stamp; 0 where either series is empty."""
    first = lambda t, c, n: read_table(spark, d, t).where(geo.finite(c)).groupBy("session_id").agg(F.min(c).alias(n))
    s = read_table(spark, d, "sessions").where("session_kind = 'sync'").select("session_id").distinct()
    j = s.join(first("cam_signals", "cam_t", "c0"), "session_id", "left").join(first("lidar_signals", "lidar_t", "l0"), "session_id", "left")
    return _r(j.select("session_id", F.coalesce(F.col("c0") - F.col("l0"), F.lit(0.0)).alias("epoch")), "epoch")


@query("zscore", f"WITH {LID}, {VAL}, s AS (SELECT session_id, avg(v) m, stddev_pop(v) s FROM val GROUP BY 1) SELECT lidar_id, round(CASE WHEN s > 1e-12 THEN (v-m)/s ELSE v-m END, 5) AS z FROM val JOIN s USING (session_id)")
def zscore(spark, d):
    v = lidar(spark, d).where(geo.finite("v"))
    s = v.groupBy("session_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = F.when(F.col("s") > 1e-12, (F.col("v") - F.col("m")) / F.when(F.col("s") > 1e-12, F.col("s"))).otherwise(F.col("v") - F.col("m"))
    return _r(v.join(s, "session_id").select("lidar_id", z.alias("z")), "z", k=5)


@query("middle_half_scale", f"""WITH {LID}, {VAL}, e AS (SELECT session_id, min(t) t0, max(t) t1 FROM val GROUP BY 1), q AS (SELECT session_id, count(*) FILTER (t >= t0 + 0.25*(t1-t0) AND t <= t0 + 0.75*(t1-t0)) k, min(v) FILTER (t >= t0 + 0.25*(t1-t0) AND t <= t0 + 0.75*(t1-t0)) l, max(v) FILTER (t >= t0 + 0.25*(t1-t0) AND t <= t0 + 0.75*(t1-t0)) h, min(v) a, max(v) b FROM val JOIN e USING (session_id) GROUP BY 1), m AS (SELECT session_id, CASE WHEN k >= 2 THEN l ELSE a END lo, CASE WHEN k >= 2 THEN h ELSE b END hi FROM q)
SELECT lidar_id, round(CASE WHEN hi - lo > 1e-12 THEN (v-lo)/(hi-lo) ELSE 0 END, 5) AS s FROM val JOIN m USING (session_id)""")  # fmt: skip
def middle_half_scale(spark, d):
    """Scaled by the range over the middle half of the recording (by all of it where fewer than two readings lie there); a flat one
    gives 0."""
    v = lidar(spark, d).where(geo.finite("v"))
    e = v.groupBy("session_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    j = v.join(e, "session_id")
    inside = F.col("t").between(F.col("t0") + 0.25 * (F.col("t1") - F.col("t0")), F.col("t0") + 0.75 * (F.col("t1") - F.col("t0")))
    few = F.count_if(inside) < 2
    m = j.groupBy("session_id").agg(F.when(few, F.min("v")).otherwise(F.min(F.when(inside, F.col("v")))).alias("lo"), F.when(few, F.max("v")).otherwise(F.max(F.when(inside, F.col("v")))).alias("hi"))
    span = F.col("hi") - F.col("lo")
    return _r(v.join(m, "session_id").select("lidar_id", F.when(span > 1e-12, (F.col("v") - F.col("lo")) / F.when(span > 1e-12, span)).otherwise(0.0).alias("s")), "s", k=5)


_SQL_PERIOD = """i AS (SELECT *, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY session_id) AS n, t - lag(t) OVER o AS dt FROM val WINDOW o AS (PARTITION BY session_id ORDER BY t, lidar_id)),
w AS (SELECT session_id, CAST(greatest(1, round_even(500000 / greatest(median(dt), 1), 0)) AS BIGINT) AS w FROM i GROUP BY 1)"""


@query("moving_average", f"""WITH {LID}, {VAL}, {_SQL_PERIOD}
SELECT a.lidar_id, round(CASE WHEN any_value(w.w) <= 1 OR any_value(a.n) < any_value(w.w) THEN any_value(a.v) ELSE sum(b.v) / any_value(w.w) END, 6) AS ma
FROM i a JOIN w USING (session_id) JOIN i b ON a.session_id = b.session_id AND b.k BETWEEN a.k - w.w // 2 AND a.k + (w.w - 1) // 2 GROUP BY a.lidar_id""")  # fmt: skip
def moving_average(spark, d):
    """Over half a second, in samples of each series' own rate; series shorter than their window stay as they are."""
    v = materialize(_valued(spark, d).select("session_id", "lidar_id", "t", "idx", "v"), "indexed")
    sized = ser.sample_period(v, ["session_id"]).select("session_id", "n", F.coalesce(ser.samples(0.5, F.col("period")), F.lit(1)).alias("w"))
    out = ser.smoothed(v.select("session_id", "lidar_id", "idx", "v").join(sized, "session_id"), ["session_id"], "v", "w", "n")
    return _r(out.select("lidar_id", F.col("v").alias("ma")), "ma")


@query("local_extrema", f"""WITH {LID}, {VAL}, w AS (SELECT lidar_id, v, lag(v) OVER o AS a, lead(v) OVER o AS b FROM val WINDOW o AS (PARTITION BY session_id ORDER BY t, lidar_id))
SELECT lidar_id, CASE WHEN v > a AND v > b THEN 1 ELSE -1 END AS kind FROM w WHERE (v > a AND v > b) OR (v < a AND v < b)""")  # fmt: skip
def local_extrema(spark, d):
    return _extrema(_valued(spark, d), "lidar_id").select("lidar_id", "kind")


def _extrema(indexed: DataFrame, id: str) -> DataFrame:
    return ser.windowed(indexed, ["session_id"], {"kind": ser.local_extremum("v")}, 1, 1).where("kind <> 0").select("session_id", id, "t", "kind")


@query("successive_difference", f"WITH {LID}, {VAL} SELECT lidar_id, round(v - lag(v) OVER (PARTITION BY session_id ORDER BY t, lidar_id), 6) AS dv FROM val")
def successive_difference(spark, d):
    return _r(ser.windowed(_valued(spark, d), ["session_id"], {"dv": lambda w: F.col("v") - F.lag("v").over(w)}, 1, 0).select("lidar_id", "dv"), "dv")


@query("cumulative_trapezoid", f"""WITH {LID}, {VAL}, w AS (SELECT session_id, lidar_id, t, coalesce((v + lag(v) OVER o)/2*(t - lag(t) OVER o)/1e6, 0) AS a FROM val WINDOW o AS (PARTITION BY session_id ORDER BY t, lidar_id))
SELECT lidar_id, round(sum(a) OVER (PARTITION BY session_id ORDER BY t, lidar_id ROWS UNBOUNDED PRECEDING), 4) AS area FROM w""")  # fmt: skip
def cumulative_trapezoid(spark, d):
    a = lambda w: F.coalesce((F.col("v") + F.lag("v").over(w)) / 2 * (F.col("t") - F.lag("t").over(w)) / 1e6, F.lit(0.0))
    steps = ser.windowed(_valued(spark, d), ["session_id"], {"a": a}, 1, 0)
    return _r(ser.running_sum(steps, ["session_id"], "a", "area").select("lidar_id", "area"), "area", k=4)


@query("detrend", f"""WITH {LID}, {VAL}, i AS (SELECT session_id, lidar_id, v, row_number() OVER (PARTITION BY session_id ORDER BY t, lidar_id) - 1 AS k FROM val), r AS (SELECT session_id, regr_slope(v, k) s, regr_intercept(v, k) b FROM i GROUP BY 1)
SELECT lidar_id, round(v - (coalesce(s, 0)*k + coalesce(b, v)), 5) AS res FROM i JOIN r USING (session_id)""")  # fmt: skip
def detrend(spark, d):
    v = _valued(spark, d)
    r = v.groupBy("session_id").agg(F.regr_slope("v", "idx").alias("s"), F.regr_intercept("v", "idx").alias("b"))
    out = F.col("v") - (F.coalesce("s", F.lit(0.0)) * F.col("idx") + F.coalesce("b", "v"))
    return _r(v.join(r, "session_id").select("lidar_id", out.alias("res")), "res", k=5)


@query("smoothed_slope", f"""WITH {LID}, {VAL} SELECT lidar_id, round((2*lead(v,2) OVER o + lead(v,1) OVER o - lag(v,1) OVER o - 2*lag(v,2) OVER o)/10, 6) AS slope FROM val WINDOW o AS (PARTITION BY session_id ORDER BY t, lidar_id)""")
def smoothed_slope(spark, d):
    """Savitzky–Golay first derivative, window 5, order 2 (per sample); null within two rows of an end."""
    f = lambda w: (2 * F.lead("v", 2).over(w) + F.lead("v", 1).over(w) - F.lag("v", 1).over(w) - 2 * F.lag("v", 2).over(w)) / 10
    return _r(ser.windowed(_valued(spark, d), ["session_id"], {"slope": f}, 2, 2).select("lidar_id", "slope"), "slope")


@query("sample_period", f"WITH {LID}, g AS (SELECT session_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, lidar_id) AS dt FROM lid) SELECT session_id, median(dt) AS period_us, CAST(greatest(1, round_even(400000 / median(dt), 0)) AS BIGINT) AS samples FROM g WHERE dt IS NOT NULL GROUP BY 1 HAVING median(dt) > 0")
def sample_period(spark, d):
    """Median sample period and the number of samples in 0.4 s, at least 1."""
    v = ser.row_index(lidar(spark, d), ["session_id"], "t", "lidar_id")
    dt = ser.windowed(v, ["session_id"], {"dt": lambda w: F.col("t") - F.lag("t").over(w)}, 1, 0).where("dt IS NOT NULL")
    m = exact_percentiles(dt, ["session_id"], "dt", {"period_us": 0.5}).where("period_us > 0")
    return m.select("session_id", "period_us", F.greatest(F.lit(1), F.rint(400_000 / F.col("period_us"))).cast("bigint").alias("samples"))


@query("sliding_minimum_offset", """WITH l AS (SELECT DISTINCT lidar_id, session_id, epoch_us(recv_ts) AS host, CAST(round(lidar_t*1000000) AS BIGINT) AS t FROM lidar_signals WHERE lidar_t IS NOT NULL AND isfinite(lidar_t))
SELECT lidar_id, host, host - t - min(host - t) OVER (PARTITION BY session_id ORDER BY host RANGE BETWEEN 5000000 PRECEDING AND CURRENT ROW) AS late_us FROM l""")  # fmt: skip
def sliding_minimum_offset(spark, d):
    """How late each message came against the least delay of the last five seconds by host clock."""
    host = F.unix_micros(F.col("recv_ts").cast("timestamp"))
    t = read_table(spark, d, "lidar_signals").where(geo.finite("lidar_t")).select("lidar_id", "session_id", host.alias("host"), _us("lidar_t").alias("t")).distinct()
    out = ser.with_halo(t.withColumn("gap", F.col("host") - F.col("t")), "host", 600_000_000, 5_000_000, 0)
    w = Window.partitionBy("session_id", "blk").orderBy("host").rangeBetween(-5_000_000, 0)
    return out.withColumn("least", F.min("gap").over(w)).where("own").select("lidar_id", "host", (F.col("gap") - F.col("least")).alias("late_us"))


@query("latest_image", """WITH l AS (SELECT DISTINCT lidar_id, session_id, CAST(round(lidar_t*1000000) AS BIGINT) AS t FROM lidar_signals WHERE lidar_t IS NOT NULL AND isfinite(lidar_t)), c AS (SELECT session_id, CAST(round(cam_t*1000000) AS BIGINT) AS t, max(cam_id) AS cam_id FROM cam_signals WHERE cam_t IS NOT NULL AND isfinite(cam_t) GROUP BY 1, 2)
SELECT lidar_id, c.cam_id FROM l ASOF LEFT JOIN c ON l.session_id = c.session_id AND l.t >= c.t""")  # fmt: skip
def latest_image(spark, d):
    """The last image at or before each range reading; null before the first."""
    left = lidar(spark, d).select("session_id", "t", F.col("lidar_id").alias("id"))
    cam = read_table(spark, d, "cam_signals").where(geo.finite("cam_t")).select("session_id", _us("cam_t").alias("t"), F.col("cam_id").alias("id"), F.col("cam_id").alias("cam_id")).distinct()
    return ser.last_seen(left, cam, ["session_id"], "t", "id", "cam_id").select(F.col("id").alias("lidar_id"), "cam_id")


@query("resample_overlap", f"""WITH {LID}, {VAL}, {IMU}, o AS (SELECT session_id, greatest(l0, i0) AS lo, least(l1, i1) AS hi FROM (SELECT session_id, min(t) l0, max(t) l1 FROM val GROUP BY 1) JOIN (SELECT session_id, min(t) i0, max(t) i1 FROM imu GROUP BY 1) USING (session_id)),
g AS (SELECT session_id, unnest(range(CAST(ceil(lo/100000) AS BIGINT), CAST(floor(hi/100000) AS BIGINT) + 1)) AS k FROM o WHERE hi > lo),
u AS (SELECT session_id, t, max(lidar_id) AS id, arg_max(v, lidar_id) AS v FROM val GROUP BY 1, 2), h AS (SELECT session_id, k, k*100000 AS t FROM g),
b AS (SELECT h.*, u.t AS t0, u.v AS v0 FROM h ASOF JOIN u ON h.session_id = u.session_id AND h.t >= u.t), a AS (SELECT b.*, u.t AS t1, u.v AS v1 FROM b ASOF JOIN u ON b.session_id = u.session_id AND b.t <= u.t)
SELECT session_id, k, round(CASE WHEN t1 > t0 THEN v0 + (v1-v0)*(t-t0)/(t1-t0) ELSE v0 END, 5) AS v FROM a""")  # fmt: skip
def resample_overlap(spark, d):
    """Range on a 0.1 s grid over the time both sensors ran, linear between neighbours."""
    v, i = lidar(spark, d).where(geo.finite("v")), imu(spark, d)
    ends = lambda df, a, b: df.groupBy("session_id").agg(F.min("t").alias(a), F.max("t").alias(b))
    o = ends(v, "l0", "l1").join(ends(i, "i0", "i1"), "session_id").select("session_id", F.greatest("l0", "i0").alias("lo"), F.least("l1", "i1").alias("hi")).where("hi > lo")
    grid = o.select("session_id", F.explode(F.sequence(F.ceil(F.col("lo") / 100_000), F.floor(F.col("hi") / 100_000))).alias("k")).select("session_id", "k", (F.col("k") * 100_000).alias("t"), F.col("k").alias("id"))
    at = v.groupBy("session_id", "t").agg(F.max(F.struct("lidar_id", "v")).alias("m"))
    known = at.select("session_id", "t", F.col("m.lidar_id").alias("id"), F.struct(F.col("t").alias("t"), F.col("m.v").alias("v")).alias("p"))
    back = ser.last_seen(grid, known, ["session_id"], "t", "id", "p").withColumnRenamed("p", "a")
    flip = lambda df: df.withColumn("t", -F.col("t"))
    both = ser.last_seen(flip(back), flip(known), ["session_id"], "t", "id", "p")
    span = F.col("p.t") - F.col("a.t")
    x = F.when(span > 0, F.col("a.v") + (F.col("p.v") - F.col("a.v")) * (-F.col("t") - F.col("a.t")) / F.when(span > 0, span)).otherwise(F.col("a.v"))
    return _r(both.where("a IS NOT NULL AND p IS NOT NULL").select("session_id", "k", x.alias("v")), "v", k=5)


@query("lagged_correlation", f"""WITH {LID}, {VAL}, i AS (SELECT session_id, lidar_id, v, cz, row_number() OVER (PARTITION BY session_id ORDER BY t, lidar_id) - 1 AS k FROM val WHERE cz IS NOT NULL AND isfinite(cz)), s AS (SELECT session_id, avg(v) ma, avg(cz) mb, stddev_pop(v) sa, stddev_pop(cz) sb, count(*) n FROM i GROUP BY 1),
z AS (SELECT i.session_id, k, (v-ma)/(CASE WHEN sa>1e-12 THEN sa ELSE 1 END) a, (cz-mb)/(CASE WHEN sb>1e-12 THEN sb ELSE 1 END) b, n FROM i JOIN s USING (session_id))
SELECT p.session_id, CAST(p.k - q.k AS INT) AS lag, round(sum(p.a*q.b)/max(p.n), 5) AS r FROM z p JOIN z q ON p.session_id = q.session_id AND p.k - q.k BETWEEN -5 AND 5 GROUP BY 1, 2""")  # fmt: skip
def lagged_correlation(spark, d):
    v = ser.row_index(lidar(spark, d).where(geo.finite("v", "cz")), ["session_id"], "t", "lidar_id")
    return _r(ser.lagged_correlation(v, ["session_id"], "v", "cz", 5).withColumn("lag", F.col("lag").cast("int")), "r", k=5)


@query("correlation_peak")
def correlation_peak(spark, d):
    """Offset of the inertial clock against range by correlation on a 200 Hz grid over ±1 s, by velocity, acceleration
    and position, with median and spread of the three."""
    side = lambda n, p: read_table(spark, d, n).where(geo.finite(f"{p}_t", f"{p}_v")).select("session_id", _us(f"{p}_t").alias("t"), F.col(f"{p}_id").alias("id"), F.col(f"{p}_v").alias("v"))
    a, b = side("lidar_signals", "lidar"), side("imu_signals", "imu")
    return _r(offset_by_correlation(a, b, ["session_id"]), "r", "shift", "offset", "median", "spread", k=5)


_SQL_REV = f"""WITH {LID}, {VAL}, {IMU}, a AS (SELECT session_id, lidar_id AS id, t FROM (SELECT *, lag(v) OVER o p, lead(v) OVER o q FROM val WINDOW o AS (PARTITION BY session_id ORDER BY t, lidar_id)) WHERE v > p AND v > q),
b AS (SELECT session_id, imu_id AS id, t FROM (SELECT *, lag(v) OVER o p, lead(v) OVER o q FROM imu WINDOW o AS (PARTITION BY session_id ORDER BY t, imu_id)) WHERE v > p AND v > q),
j AS (SELECT a.session_id, a.id AS a_id, b.id AS b_id, abs(a.t-b.t) AS gap, b.t - a.t AS diff FROM a JOIN b ON a.session_id = b.session_id AND b.t BETWEEN a.t - 200000 AND a.t + 200000),
x AS (SELECT *, row_number() OVER (PARTITION BY session_id, a_id ORDER BY gap, b_id) ra, row_number() OVER (PARTITION BY session_id, b_id ORDER BY gap, a_id) rb FROM j)"""


@query("mutual_reversals", _SQL_REV + " SELECT session_id, a_id, b_id, gap FROM x WHERE ra = 1 AND rb = 1")
def mutual_reversals(spark, d):
    """Maxima of range and inertial signal that are each other's nearest within 0.2 s."""
    return _mutual(spark, d).drop("diff")


def _mutual(spark, d) -> DataFrame:
    a = _extrema(_valued(spark, d), "lidar_id").where("kind = 1").select("session_id", "t", F.col("lidar_id").alias("id"))
    i = ser.row_index(imu(spark, d), ["session_id"], "t", "imu_id")
    b = _extrema(i, "imu_id").where("kind = 1").select("session_id", "t", F.col("imu_id").alias("id"))
    return spa.mutual_nearest(a, b, ["session_id"], "t", "id", 200_000)


@query("reversal_offsets", _SQL_REV + """, m AS (SELECT * FROM x WHERE ra = 1 AND rb = 1), q AS (SELECT session_id, median(diff) AS mid FROM m GROUP BY 1)
SELECT session_id, count(*) AS n, round(median(diff), 4) AS "offset", round(stddev_pop(diff), 4) AS std FROM m JOIN q USING (session_id) WHERE abs(diff - mid) <= 20000 GROUP BY 1""")
def reversal_offsets(spark, d):
    """Signed offset of paired maxima per session (inertial less range, µs): those within 20 ms of the median, counted anew."""
    return _r(offsets_of_pairs(_mutual(spark, d), ["session_id"], 20_000), "offset", "std", k=4)


_ALL_SIGNALS = """u AS (SELECT DISTINCT session_id, 'lidar' AS sensor, lidar_id AS id, CAST(round(lidar_t*1000000) AS BIGINT) AS t, lidar_v AS v FROM lidar_signals WHERE isfinite(lidar_t) AND isfinite(lidar_v)
UNION ALL SELECT DISTINCT session_id, 'camera', cam_id, CAST(round(cam_t*1000000) AS BIGINT), cam_v FROM cam_signals WHERE isfinite(cam_t) AND isfinite(cam_v)
UNION ALL SELECT DISTINCT session_id, 'imu', imu_id, CAST(round(imu_t*1000000) AS BIGINT), imu_v FROM imu_signals WHERE isfinite(imu_t) AND isfinite(imu_v))"""
_KEYS = "session_id, sensor"
_SQL_TURNS = f"""WITH RECURSIVE {_ALL_SIGNALS},
i AS (SELECT *, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY {_KEYS}) AS n, t - lag(t) OVER o AS dt FROM u WINDOW o AS (PARTITION BY {_KEYS} ORDER BY t, id)),
w AS (SELECT {_KEYS}, CAST(greatest(1, round_even(300000 / greatest(median(dt), 1), 0)) AS BIGINT) AS w, CAST(greatest(1, round_even(500000 / greatest(median(dt), 1), 0)) AS BIGINT) AS far FROM i WHERE n >= 3 GROUP BY ALL),
f AS (SELECT {_KEYS}, a.k, any_value(a.id) AS id, any_value(a.t) AS t, any_value(w.far) AS far, CASE WHEN any_value(w.w) <= 1 OR any_value(a.n) < any_value(w.w) THEN any_value(a.v) ELSE round(sum(b.v) / any_value(w.w), 9) END AS v
 FROM i a JOIN w USING ({_KEYS}) JOIN i b USING ({_KEYS}) WHERE b.k BETWEEN a.k - w.w // 2 AND a.k + (w.w - 1) // 2 GROUP BY {_KEYS}, a.k),
h AS (SELECT {_KEYS}, greatest(0.2 * (quantile_cont(v, 0.95) - quantile_cont(v, 0.05)), 1e-9) AS high FROM f GROUP BY ALL),
s AS MATERIALIZED (SELECT {_KEYS}, kind, k, far, kind * v AS v FROM f, (SELECT unnest([1, -1]) AS kind)),
r AS (SELECT *, CASE WHEN v = lag(v) OVER o THEN 0 ELSE 1 END AS fresh FROM s WINDOW o AS (PARTITION BY {_KEYS}, kind ORDER BY k)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY {_KEYS}, kind ORDER BY k) AS run FROM r),
c AS (SELECT {_KEYS}, kind, run, any_value(v) AS v, any_value(far) AS far, (min(k) + max(k)) // 2 AS k FROM g GROUP BY ALL),
e AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS b FROM c WINDOW o AS (PARTITION BY {_KEYS}, kind ORDER BY run)),
p AS MATERIALIZED (SELECT {_KEYS}, kind, k, v, far, row_number() OVER (PARTITION BY {_KEYS}, kind ORDER BY v DESC, k) AS rk FROM e WHERE v > a AND v > b),
z AS (SELECT DISTINCT {_KEYS}, kind, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept FROM p
 UNION ALL SELECT p.session_id, p.sensor, p.kind, p.rk, CASE WHEN len(list_filter(z.kept, lambda x: abs(x - p.k) < p.far)) = 0 THEN list_append(z.kept, CAST(p.k AS BIGINT)) ELSE z.kept END
 FROM z JOIN p ON p.session_id = z.session_id AND p.sensor = z.sensor AND p.kind = z.kind AND p.rk = z.rk + 1),
l AS (SELECT {_KEYS}, kind, unnest(arg_max(kept, rk)) AS k FROM z GROUP BY {_KEYS}, kind),
q AS (SELECT p.* FROM p JOIN l USING ({_KEYS}, kind, k)),
y AS (SELECT q.session_id, q.sensor, q.kind, q.k, q.v, coalesce(max(s.k) FILTER (s.k < q.k AND s.v > q.v), -1) AS lo, coalesce(min(s.k) FILTER (s.k > q.k AND s.v > q.v), 9000000000) AS hi
 FROM q JOIN s USING ({_KEYS}, kind) GROUP BY ALL),
x AS (SELECT y.session_id, y.sensor, y.kind, y.k, y.v - greatest(min(s.v) FILTER (s.k > y.lo AND s.k <= y.k), min(s.v) FILTER (s.k >= y.k AND s.k < y.hi)) AS prom, any_value(y.v) AS v
 FROM y JOIN s USING ({_KEYS}, kind) GROUP BY y.session_id, y.sensor, y.kind, y.k, y.v),
turns AS (SELECT {_KEYS}, f.id, f.t, x.kind FROM x JOIN h USING ({_KEYS}) JOIN f USING ({_KEYS}, k) WHERE prom >= high)"""


def _turns(spark, d) -> DataFrame:
    parts = None
    for table, p, name in (("lidar_signals", "lidar", "lidar"), ("cam_signals", "cam", "camera"), ("imu_signals", "imu", "imu")):
        one = read_table(spark, d, table).where(geo.finite(f"{p}_t", f"{p}_v")).select("session_id", F.lit(name).alias("sensor"), F.col(f"{p}_id").alias("id"), _us(f"{p}_t").alias("t"), F.col(f"{p}_v").alias("v")).dropDuplicates(["id"])
        parts = one if parts is None else parts.unionByName(one)
    return turning_points(parts, ["session_id", "sensor"])


@query("turning_points", _SQL_TURNS + " SELECT session_id, sensor, id, kind FROM turns")
def signal_turning_points(spark, d):
    """Maxima and minima of all three smoothed signals of each session."""
    return _turns(spark, d).select("session_id", "sensor", "id", "kind")


@query("reversal_sync", _SQL_TURNS + """, pr AS (SELECT * FROM (VALUES ('imu', 'lidar'), ('imu', 'camera'), ('lidar', 'camera')) v(ref, other)),
j AS (SELECT a.session_id, ref, other, a.id AS a_id, b.id AS b_id, b.t - a.t AS diff FROM pr JOIN turns a ON a.sensor = ref JOIN turns b ON b.sensor = other AND a.session_id = b.session_id AND abs(a.t - b.t) <= 2000000),
m AS (SELECT *, row_number() OVER (PARTITION BY session_id, ref, other, a_id ORDER BY abs(diff), b_id) ra, row_number() OVER (PARTITION BY session_id, ref, other, b_id ORDER BY abs(diff), a_id) rb FROM j),
mm AS (SELECT *, median(diff) OVER (PARTITION BY session_id, ref, other) AS mid FROM m WHERE ra = 1 AND rb = 1)
SELECT session_id, ref, other, count(*) AS n, round(median(diff), 4) AS "offset", round(stddev_pop(diff), 4) AS std FROM mm WHERE abs(diff - mid) <= 500000 GROUP BY ALL""")  # fmt: skip
def reversal_sync(spark, d):
    """Clock offsets of the three pairs of sensors by mutually nearest turning points, half a second about their median."""
    turns = materialize(_turns(spark, d), "turns")
    return _r(offset_by_reversals(turns, ["session_id"], "sensor", [("imu", "lidar"), ("imu", "camera"), ("lidar", "camera")], 2_000_000, 500_000), "offset", "std", k=4)


@query("arrival_counters", "SELECT session_id, count(DISTINCT lidar_id) AS published, count(*) - count(DISTINCT lidar_id) AS repeated, count(DISTINCT lidar_id) FILTER (lidar_t IS NULL) AS unstamped FROM lidar_signals GROUP BY 1")
def arrival_counters(spark, d):
    t = read_table(spark, d, "lidar_signals").groupBy("session_id", "lidar_id").agg(F.count("*").alias("k"), F.max(F.col("lidar_t").isNull()).alias("none"))
    return t.groupBy("session_id").agg(F.count("*").alias("published"), F.sum(F.col("k") - 1).alias("repeated"), F.count_if("none").alias("unstamped"))


@query("long_signals", f"WITH {LID} SELECT lidar_id, u.sensor, round(u.value, 6) AS value FROM lid, (SELECT unnest(['cx','cy','cz']) AS sensor, unnest([cx, cy, cz]) AS value) u WHERE u.value IS NOT NULL AND isfinite(u.value)")
def long_signals(spark, d):
    """Wide feature rows to the long form (sensor, value)."""
    t = lidar(spark, d).select("lidar_id", "cx", "cy", "cz").unpivot("lidar_id", ["cx", "cy", "cz"], "sensor", "value")
    return _r(t.where(geo.finite("value")), "value")


@query("axis_channel", "SELECT cam_id, CASE cam_axis WHEN 'u' THEN cam_u WHEN 'v' THEN cam_v_px WHEN 'scale' THEN cam_scale WHEN 'width' THEN cam_width END AS value FROM (SELECT DISTINCT cam_id, session_id, cam_u, cam_v_px, cam_scale, cam_width FROM cam_signals) JOIN (SELECT DISTINCT session_id, cam_axis FROM sessions) USING (session_id) WHERE cam_axis IS NOT NULL AND CASE cam_axis WHEN 'u' THEN cam_u WHEN 'v' THEN cam_v_px WHEN 'scale' THEN cam_scale WHEN 'width' THEN cam_width END IS NOT NULL AND NOT isnan(CASE cam_axis WHEN 'u' THEN cam_u WHEN 'v' THEN cam_v_px WHEN 'scale' THEN cam_scale WHEN 'width' THEN cam_width END)")
def axis_channel(spark, d):
    """The camera feature the session names as its axis."""
    axis = read_table(spark, d, "sessions").select("session_id", "cam_axis").where("cam_axis IS NOT NULL").distinct()
    c = read_table(spark, d, "cam_signals").select("cam_id", "session_id", "cam_u", "cam_v_px", "cam_scale", "cam_width").dropDuplicates(["cam_id"]).join(axis, "session_id")
    v = geo.channel("cam_axis", {"u": "cam_u", "v": "cam_v_px", "scale": "cam_scale", "width": "cam_width"})
    return c.select("cam_id", v.alias("value")).where(geo.finite("value"))


@query("windowed_arrivals", "SELECT session_id, CAST(floor(epoch_us(recv_ts) / 60000000) AS BIGINT) AS minute, count(DISTINCT lidar_id) AS n FROM lidar_signals GROUP BY 1, 2")
def windowed_arrivals(spark, d):
    """Tumbling windows of one minute by arrival (an extra of Spark's, not of the surveyed tools)."""
    t = read_table(spark, d, "lidar_signals").withColumn("ts", F.col("recv_ts").cast("timestamp"))
    w = t.groupBy("session_id", F.window("ts", "1 minute").alias("w")).agg(F.countDistinct("lidar_id").alias("n"))
    return w.select("session_id", F.expr("unix_micros(w.start) div 60000000").alias("minute"), "n")


TAU = 2 * math.pi


@query("angular_gaps", f"""WITH {PTS}, a AS (SELECT frame_id, ring, atan2(y, x) AS a, point_id FROM ok), g AS (SELECT frame_id, ring, lead(a) OVER w - a AS gap, first_value(a) OVER (PARTITION BY frame_id, ring ORDER BY a, point_id) AS a0, last_value(a) OVER (PARTITION BY frame_id, ring ORDER BY a, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a1 FROM a WINDOW w AS (PARTITION BY frame_id, ring ORDER BY a, point_id))
SELECT frame_id, ring, count(*) AS n, round(greatest(coalesce(max(gap), 0), {TAU} + min(a0) - max(a1)), 5) AS widest FROM g GROUP BY 1, 2 HAVING count(*) >= 4""")  # fmt: skip
def angular_gaps(spark, d):
    """Widest gap in azimuth between successive returns of a ring, the one through ±180° included."""
    a = good(spark, d).select("frame_id", "ring", "point_id", F.atan2("y", "x").alias("a"))
    w = Window.partitionBy("frame_id", "ring").orderBy("a", "point_id")
    g = a.withColumn("gap", F.lead("a").over(w) - F.col("a"))
    out = g.groupBy("frame_id", "ring").agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), F.lit(TAU) + F.min("a") - F.max("a")).alias("widest")).where("n >= 4")
    return _r(out, "widest", k=5)


# --- fits ------------------------------------------------------------------------------------------------


@query("rigid_fits", f"""WITH {PTS}, f AS (SELECT session_id, frame_id, row_number() OVER (PARTITION BY session_id ORDER BY frame_id) - 1 AS k FROM (SELECT DISTINCT session_id, frame_id FROM pts)), n AS (SELECT frame_id, count(*) AS n FROM ok GROUP BY 1)
SELECT frame_id, n, round(degrees(0.01*k), 4) AS yaw, CAST(round(0.1*k, 4) AS DOUBLE) AS tx, CAST(round(-0.05*k, 4) AS DOUBLE) + CAST(0 AS DOUBLE) AS ty, true AS exact FROM f JOIN n USING (frame_id) WHERE n >= 50""")  # fmt: skip
def rigid_fits(spark, d):
    """Each frame is moved by a known transform and the transform is found again from the point pairs."""
    frames = read_table(spark, d, "pointcloud_points").select("session_id", "frame_id").distinct()
    k = frames.withColumn("k", (F.row_number().over(Window.partitionBy("session_id").orderBy("frame_id")) - 1).cast("bigint"))
    a = 0.01 * F.col("k")
    m = [[F.cos(a), -F.sin(a), 0.0, 0.1 * F.col("k")], [F.sin(a), F.cos(a), 0.0, -0.05 * F.col("k")], [0.0, 0.0, 1.0, 0.0]]
    x, y, z = geo.rigid(m)
    pairs = good(spark, d).join(k, ["session_id", "frame_id"]).select("frame_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), x.alias("bx"), y.alias("by"), z.alias("bz"))
    r = fit.rigid_fit(pairs, ["frame_id"]).where("n >= 50")
    return r.select("frame_id", "n", F.round(F.degrees(F.atan2(F.col("r")[3], F.col("r")[0])), 4).alias("yaw"), (F.round(F.col("t")[0], 4) + 0.0).alias("tx"), (F.round(F.col("t")[1], 4) + 0.0).alias("ty"), (F.col("rms") < 1e-4).alias("exact"))


@query("frame_planes")
def frame_planes(spark, d):
    """The plane with most inliers in every frame, refitted."""
    return _r(fit.ransac_planes(good(spark, d), ["frame_id"], "point_id", 0.05), "a", "b", "c", "d")


@query("session_planes")
def session_planes(spark, d):
    """The planes of each session, found one after the other until none has 50 points."""
    return _r(fit.peel_planes(good(spark, d), ["session_id"], "point_id", 0.05, least=50), "a", "b", "c", "d")


@query("frame_hulls")
def frame_hulls(spark, d):
    """Corners of each frame's outline in x, y."""
    return fit.convex_hulls(good(spark, d).select("frame_id", "x", "y"), ["frame_id"])


@query("signal_peaks")
def signal_peaks(spark, d):
    """Peaks of the range at least 4 samples apart with 5 cm prominence."""
    return fit.series_peaks(_valued(spark, d), ["session_id"], "lidar_id", 4, 0.05)


@query("voxel_normals", f"""WITH {PTS}, t AS (SELECT session_id, CAST(floor(x/2) AS BIGINT) AS vx, CAST(floor(y/2) AS BIGINT) AS vy, CAST(floor(z/2) AS BIGINT) AS vz, x - (floor(x/2)*2+1) AS x, y - (floor(y/2)*2+1) AS y, z - (floor(z/2)*2+1) AS z FROM ok),
f AS (SELECT session_id, vx, vy, vz, count(*) n, sum(x) sx, sum(y) sy, sum(z) sz, sum(x*x) sxx, sum(x*y) sxy, sum(y*y) syy, sum(x*z) sxz, sum(y*z) syz FROM t GROUP BY 1, 2, 3, 4 HAVING count(*) >= 12),
d AS (SELECT *, sxx*(syy*n-sy*sy) - sxy*(sxy*n-sy*sx) + sx*(sxy*sy-syy*sx) AS det FROM f),
p AS (SELECT session_id, vx, vy, vz, n, (sxz*(syy*n-sy*sy) - sxy*(syz*n-sy*sz) + sx*(syz*sy-syy*sz))/det AS a, (sxx*(syz*n-sz*sy) - sxz*(sxy*n-sy*sx) + sx*(sxy*sz-syz*sx))/det AS b FROM d WHERE abs(det) > 1e-3)
SELECT session_id, vx, vy, vz, n, round(1/sqrt(a*a+b*b+1), 3) AS upright FROM p""")  # fmt: skip
def voxel_normals(spark, d):
    """How upright the surface stands in each 2 m voxel: z of the normal of the plane fitted to its points."""
    v = {c: spa.cell(c, 2.0) for c in "xyz"}
    t = good(spark, d).select("session_id", *[e.alias(f"v{c}") for c, e in v.items()], *[(F.col(c) - (v[c] * 2 + 1)).alias(c) for c in "xyz"])
    f = spa.plane_fit(t, ["session_id", "vx", "vy", "vz"], 1e-3).where("a IS NOT NULL AND n >= 12")
    return _r(f.select("session_id", "vx", "vy", "vz", "n", (1 / geo.norm("a", "b", F.lit(1.0))).alias("upright")), "upright", k=3)


@query("vertex_ids", f"WITH {_SQL_TILES} SELECT frame_id, i, j, row_number() OVER (PARTITION BY frame_id ORDER BY i, j) - 1 AS vid FROM g")
def vertex_ids(spark, d):
    """Tiles with a height numbered row by row inside their frame."""
    w = Window.partitionBy("frame_id").orderBy("i", "j")
    return _tiles(spark, d).select("frame_id", "i", "j", (F.row_number().over(w) - 1).cast("bigint").alias("vid"))


@query("last_frames", f"WITH {PTS}, r AS (SELECT session_id, frame_id, dense_rank() OVER (PARTITION BY session_id ORDER BY frame_id DESC) AS k FROM (SELECT DISTINCT session_id, frame_id FROM pts)) SELECT session_id, count(*) AS n, count(DISTINCT frame_id) AS frames FROM ok JOIN r USING (session_id, frame_id) WHERE k <= 3 GROUP BY 1")
def last_frames(spark, d):
    """Points in the last three frames of every session: frames are ranked, points only joined."""
    f = read_table(spark, d, "pointcloud_points").select("session_id", "frame_id").distinct()
    w = Window.partitionBy("session_id").orderBy(F.desc("frame_id"))
    last = f.withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k")
    return good(spark, d).join(last, ["session_id", "frame_id"]).groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("frame_id").alias("frames"))


@query("grid_vertices", f"WITH {PTS}, e AS (SELECT session_id, CAST(floor(min(x)/8) AS BIGINT) i0, CAST(ceil(max(x)/8) AS BIGINT) i1, CAST(floor(min(y)/8) AS BIGINT) j0, CAST(ceil(max(y)/8) AS BIGINT) j1 FROM ok GROUP BY 1), g AS (SELECT session_id, unnest(range(i0, i1)) AS i, j0, j1 FROM e) SELECT session_id, i, unnest(range(j0, j1)) AS j FROM g")
def grid_vertices(spark, d):
    """An 8 m grid over every session's extent, upper ends excluded; whole numbers until the last step."""
    e = good(spark, d).groupBy("session_id").agg(*[f.alias(n) for n, f in (("i0", F.floor(F.min("x") / 8)), ("i1", F.ceil(F.max("x") / 8)), ("j0", F.floor(F.min("y") / 8)), ("j1", F.ceil(F.max("y") / 8)))])
    steps = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b) - 1))
    return e.where("i1 > i0 AND j1 > j0").withColumn("i", steps("i0", "i1")).withColumn("j", steps("j0", "j1")).select("session_id", "i", "j")


@query("offset_consensus", """WITH a AS (SELECT session_id, min(lidar_t) FILTER (isfinite(lidar_t)) AS l0, max(lidar_t) FILTER (isfinite(lidar_t)) AS l1, avg(lidar_t) FILTER (isfinite(lidar_t)) AS lm FROM (SELECT DISTINCT session_id, lidar_id, lidar_t FROM lidar_signals) GROUP BY 1),
b AS (SELECT session_id, min(cam_t) FILTER (isfinite(cam_t)) AS c0, max(cam_t) FILTER (isfinite(cam_t)) AS c1, avg(cam_t) FILTER (isfinite(cam_t)) AS cm FROM (SELECT DISTINCT session_id, cam_id, cam_t FROM cam_signals) GROUP BY 1)
SELECT session_id, round(median(v), 5) AS middle, round(max(v) - min(v), 5) AS spread FROM (SELECT session_id, unnest([c0-l0, c1-l1, cm-lm]) AS v FROM a JOIN b USING (session_id)) GROUP BY 1""")  # fmt: skip
def offset_consensus(spark, d):
    """Three estimates of camera minus range time (starts, ends, means): their median and spread."""
    def ends(table: str, i: str, t: str, p: str) -> DataFrame:
        once = read_table(spark, d, table).where(geo.finite(t)).select("session_id", i, t).distinct()
        return once.groupBy("session_id").agg(F.min(t).alias(f"{p}0"), F.max(t).alias(f"{p}1"), F.avg(t).alias(f"{p}m"))

    j = ends("lidar_signals", "lidar_id", "lidar_t", "l").join(ends("cam_signals", "cam_id", "cam_t", "c"), "session_id")
    three = F.array_sort(F.array(*[F.col(f"c{k}") - F.col(f"l{k}") for k in "01m"]))
    return _r(j.select("session_id", three[1].alias("middle"), (three[2] - three[0]).alias("spread")), "middle", "spread", k=5)


@query("wall_features")
def wall_features(spark, d):
    """Distance of the sensor from each frame's main plane and the centroid of its inliers."""
    p = good(spark, d)
    planes = fit.ransac_planes(p, ["frame_id"], "point_id", 0.05, least=15)
    inl = p.join(planes, "frame_id").where(F.abs(geo.plane_distance("a", "b", "c", "d")) < 0.05)
    g = inl.groupBy("frame_id", "inliers").agg((F.abs(F.first("d")) / geo.norm(F.first("a"), F.first("b"), F.first("c"))).alias("dist"), *[F.avg(c).alias(f"c{c}") for c in "xyz"])
    return _r(g, "dist", "cx", "cy", "cz", k=5)


# --- neighbourhoods of thinned frames ----------------------------------------------------------------------

_SQL_FLAT = f"""{PTS}, flat AS (SELECT frame_id, min(point_id) AS id, arg_min(x, point_id) AS x, arg_min(y, point_id) AS y FROM ok GROUP BY frame_id, CAST(floor(x / 0.5) AS BIGINT), CAST(floor(y / 0.5) AS BIGINT)),
cells AS (SELECT *, CAST(floor(x / 1.25) AS BIGINT) AS cx, CAST(floor(y / 1.25) AS BIGINT) AS cy FROM flat),
around AS (SELECT frame_id, id AS b, x AS qx, y AS qy, cx + dx AS cx, cy + dy AS cy FROM cells, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
near AS (SELECT frame_id, id, b, atan2(qy - y, qx - x) AS t FROM cells JOIN around USING (frame_id, cx, cy) WHERE id <> b AND (x-qx)*(x-qx) + (y-qy)*(y-qy) <= 1.5625)"""


@query("frame_borders", f"""WITH {_SQL_FLAT}, g AS (SELECT frame_id, id, t, lead(t) OVER (PARTITION BY id ORDER BY t) - t AS gap FROM near)
SELECT frame_id, id AS point_id, round(greatest(max(gap), {TAU} + min(t) - max(t)), 4) AS gap FROM g GROUP BY 1, 2 HAVING count(*) >= 3 AND greatest(max(gap), {TAU} + min(t) - max(t)) > 2.0""")  # fmt: skip
def frame_borders(spark, d):
    """Points of each frame's layout (first point of every half-metre column) that leave an angle of 2 rad open."""
    flat = spa.voxel_first(good(spark, d), ["frame_id"], 0.5, "point_id", ["x", "y"]).withColumnRenamed("point_id", "id").withColumn("z", F.lit(0.0))
    out = feat.boundary_points(flat, ["frame_id"], 1.25, gap=2.0)
    return _r(out.select("frame_id", F.col("id").alias("point_id"), "gap"), "gap", k=4)


@query("frame_normals")
def frame_normals(spark, d):
    """Normals of frames thinned to half-metre voxels."""
    thin = feat.thinned(good(spark, d), ["frame_id"], 0.5)
    return feat.normals(thin, ["frame_id"], 1.0).select("frame_id", "x", "y", "z", "nx", "ny", "nz")


@query("frame_features")
def frame_features(spark, d):
    """Point feature histograms of frames thinned to half-metre voxels."""
    thin = feat.thinned(good(spark, d), ["frame_id"], 0.5)
    return feat.feature_histograms(feat.normals(thin, ["frame_id"], 1.0), ["frame_id"], 1.5).select("frame_id", "x", "y", "z", "f")
