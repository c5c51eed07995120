"""Further queries over the sensor tables, each through a public operator, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry as geo
from pointloom.operators import fit
from pointloom.operators import series as ser
from pointloom.operators import spatial as spa
from pointloom.plans import pipelines
from pointloom.plans.reference_queries import _ALL_SIGNALS, _SQL_TILES, LID, PTS, VAL, _r, _sql_r, _tiles, _us, _valued, good, points
from pointloom.session import read_table
from pointloom.sources.pointcloud2 import decode_points, encode_points, layout
from pointloom.sources.sinks import ply_lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _frame_order(spark, d) -> DataFrame:
    frames = read_table(spark, d, "pointcloud_points").select("session_id", "frame_id").distinct()
    return frames.withColumn("k", (F.row_number().over(Window.partitionBy("session_id").orderBy("frame_id")) - 1).cast("double"))


_ORDER = "f AS (SELECT session_id, frame_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY frame_id) - 1 AS DOUBLE) AS k FROM (SELECT DISTINCT session_id, frame_id FROM pts))"


@query("driver_transform", f"""WITH {PTS}, {_ORDER}, a AS (SELECT point_id, x, y, z, 0.02*k AS r, -0.01*k AS p, 0.03*k AS w, 0.1*k AS tx FROM ok JOIN f USING (session_id, frame_id)),
t AS (SELECT point_id, cos(w)*cos(p)*x + (cos(w)*sin(p)*sin(r) - sin(w)*cos(r))*y + (cos(w)*sin(p)*cos(r) + sin(w)*sin(r))*z + tx AS xc,
 sin(w)*cos(p)*x + (sin(w)*sin(p)*sin(r) + cos(w)*cos(r))*y + (sin(w)*sin(p)*cos(r) - cos(w)*sin(r))*z - 0.5 AS yc, -sin(p)*x + cos(p)*sin(r)*y + cos(p)*cos(r)*z + 0.25 AS zc FROM a)
SELECT point_id, {_sql_r('xc yc zc', 5)} FROM t""")  # fmt: skip
def driver_transform(spark, d):
    """Points turned by roll, pitch and yaw and moved; the pose follows the number of the frame."""
    p = good(spark, d).join(_frame_order(spark, d), ["session_id", "frame_id"])
    k = F.col("k")
    out = geo.rigid(geo.rpy(0.1 * k, F.lit(-0.5), F.lit(0.25), 0.02 * k, -0.01 * k, 0.03 * k))
    return _r(p.select("point_id", *[e.alias(n) for e, n in zip(out, ("xc", "yc", "zc"), strict=True)]), "xc", "yc", "zc", k=5)


_FACES = """b AS (SELECT frame_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM ok GROUP BY 1),
pl AS (SELECT frame_id, unnest([{'i': 0, 'a': 1.0, 'b': 0.0, 'c': 0.0, 'd': -x0}, {'i': 1, 'a': -1.0, 'b': 0.0, 'c': 0.0, 'd': x1}, {'i': 2, 'a': 0.0, 'b': 1.0, 'c': 0.0, 'd': -y0}, {'i': 3, 'a': 0.0, 'b': -1.0, 'c': 0.0, 'd': y1}, {'i': 4, 'a': 0.0, 'b': 0.0, 'c': 1.0, 'd': -z0}, {'i': 5, 'a': 0.0, 'b': 0.0, 'c': -1.0, 'd': z1}]) AS p FROM b),
l AS (SELECT m.frame_id, m.p.i AS i, n.p.i AS k, m.p.b*n.p.c - m.p.c*n.p.b AS ux, m.p.c*n.p.a - m.p.a*n.p.c AS uy, m.p.a*n.p.b - m.p.b*n.p.a AS uz,
 n.p.d*m.p.a - m.p.d*n.p.a AS qx, n.p.d*m.p.b - m.p.d*n.p.b AS qy, n.p.d*m.p.c - m.p.d*n.p.c AS qz FROM pl m JOIN pl n ON m.frame_id = n.frame_id AND m.p.i < n.p.i),
e AS (SELECT frame_id, i, k, qy*uz - qz*uy AS px, qz*ux - qx*uz AS py, qx*uy - qy*ux AS pz, ux, uy, uz FROM l WHERE ux*ux + uy*uy + uz*uz > 0)"""


def _box_lines(spark, d) -> DataFrame:
    """Lines in which the faces of each frame's box meet: frame_id, i, k, px … uz."""
    box = good(spark, d).groupBy("frame_id").agg(*[e for c in "xyz" for e in (F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1"))])
    sides = [(s if c == "x" else 0.0, s if c == "y" else 0.0, s if c == "z" else 0.0, F.col(f"{c}{e}") * -s) for c in "xyz" for e, s in ((0, 1.0), (1, -1.0))]
    planes = box.select("frame_id", F.posexplode(F.array(*[F.struct(*[(v if not isinstance(v, float) else F.lit(v)).alias(n) for v, n in zip(s, "abcd", strict=True)]) for s in sides])).alias("i", "p"))
    other = planes.select("frame_id", F.col("i").alias("k"), F.col("p").alias("q"))
    pairs = planes.join(other, "frame_id").where("i < k")
    at, along = geo.plane_line([F.col(f"p.{c}") for c in "abcd"], [F.col(f"q.{c}") for c in "abcd"])
    out = pairs.select("frame_id", "i", "k", *[e.alias(f"p{c}") for e, c in zip(at, "xyz", strict=True)], *[e.alias(f"u{c}") for e, c in zip(along, "xyz", strict=True)])
    return out.where("ux IS NOT NULL")


@query("box_edges", f"WITH {PTS}, {_FACES} SELECT frame_id, i, k, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in ('px', 'py', 'pz', 'ux', 'uy', 'uz'))} FROM e")
def box_edges(spark, d):
    """The twelve lines in which the faces of each frame's box meet, by their point nearest the origin and direction."""
    cols = ("px", "py", "pz", "ux", "uy", "uz")
    return _box_lines(spark, d).select("frame_id", "i", "k", *[(F.round(c, 5) + 0.0).alias(c) for c in cols])


_SNAP = "s0 AS (SELECT point_id, x, y, z, x0, x1, y0, y1 FROM ok JOIN b USING (frame_id))"
for _n, (_a, _b) in enumerate((("x0", "y0"), ("x0", "y1"), ("x1", "y0"), ("x1", "y1")), 1):
    _SNAP += f", s{_n} AS (SELECT point_id, CASE WHEN sqrt((x-{_a})*(x-{_a})+(y-{_b})*(y-{_b})) < 0.75 THEN {_a} ELSE x END AS x, CASE WHEN sqrt((x-{_a})*(x-{_a})+(y-{_b})*(y-{_b})) < 0.75 THEN {_b} ELSE y END AS y, z, x0, x1, y0, y1 FROM s{_n - 1})"


@query("edge_snap", f"WITH {PTS}, {_FACES}, {_SNAP} SELECT point_id, {_sql_r('x y z', 5)} FROM s4")
def edge_snap(spark, d):
    """Points within 0.75 m of an upright edge of their frame's box are moved onto it, edge after edge."""
    lines = _box_lines(spark, d).where("i < 2 AND k IN (2, 3)")
    line = F.struct("i", "k", F.struct(*[F.col(f"p{c}").alias(c) for c in "xyz"]).alias("p"), F.struct(*[F.col(f"u{c}").alias(c) for c in "xyz"]).alias("u"))
    packed = lines.groupBy("frame_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))  # four a frame
    p = good(spark, d).join(packed, "frame_id").select("point_id", geo.snapped("xyz", F.col("lines"), 0.75).alias("s"))
    return _r(p.select("point_id", "s.x", "s.y", "s.z"), "x", "y", "z", k=5)


@query("padded_frames", f"""WITH {PTS}, r AS (SELECT frame_id, point_id, x, y, z, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx, point_id) - 1 AS slot FROM ok),
g AS (SELECT frame_id, unnest(range(300)) AS slot FROM (SELECT DISTINCT frame_id FROM ok))
SELECT frame_id, slot, coalesce(point_id, 0) AS point_id, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z FROM g LEFT JOIN r USING (frame_id, slot)""")  # fmt: skip
def padded_frames(spark, d):
    """Every frame with exactly 300 points: clipped, or filled up with zeros (the size is the operator's parameter)."""
    p = good(spark, d).select("frame_id", "point_id", "x", "y", "z", F.struct("point_idx", "point_id").alias("o"))
    return spa.padded(p, ["frame_id"], "o", 300, ["point_id", "x", "y", "z"])


@query("frame_stamps", f"WITH {PTS}, h AS (SELECT frame_id, max(epoch_us(recv_ts)) AS host_us FROM pointcloud_points GROUP BY 1) SELECT frame_id, round(min(point_t), 6) AS first_t, round(max(point_t), 6) AS last_t, any_value(host_us) AS host_us FROM pts JOIN h USING (frame_id) GROUP BY 1")
def frame_stamps(spark, d):
    """The three times a frame can be stamped with: its first or last point by the sensor's clock, or its arrival."""
    host = F.unix_micros(F.col("recv_ts").cast("timestamp"))
    g = read_table(spark, d, "pointcloud_points").groupBy("frame_id").agg(F.min("point_t").alias("first_t"), F.max("point_t").alias("last_t"), F.max(host).alias("host_us"))
    return _r(g, "first_t", "last_t")


@query("angle_split", f"""WITH {PTS}, a AS (SELECT frame_id, point_id, point_idx, degrees(atan2(y, x)) + CASE WHEN y < 0 THEN 360 ELSE 0 END AS a FROM ok),
w AS (SELECT *, CASE WHEN a < lag(a) OVER o - 180 THEN 1 ELSE 0 END AS cut FROM a WINDOW o AS (PARTITION BY frame_id ORDER BY point_idx, point_id)),
s AS (SELECT frame_id, sum(cut) OVER (PARTITION BY frame_id ORDER BY point_idx, point_id) AS part FROM w) SELECT frame_id, CAST(part AS BIGINT) AS part, count(*) AS n FROM s GROUP BY 1, 2""")  # fmt: skip
def angle_split(spark, d):
    """Returns in order of measurement, split where the azimuth passes its start."""
    a = F.degrees(F.atan2("y", "x")) + F.when(F.col("y") < 0, 360.0).otherwise(0.0)
    rows = ser.row_index(good(spark, d).withColumn("a", a), ["frame_id"], "point_idx", "point_id", bin_us=20_000)
    cut = lambda w: F.coalesce((F.col("a") < F.lag("a").over(w) - 180).cast("int"), F.lit(0)).cast("double")
    part = ser.running_sum(ser.windowed(rows, ["frame_id"], {"cut": cut}, 1, 0), ["frame_id"], "cut", "part")
    return part.groupBy("frame_id", F.col("part").cast("bigint").alias("part")).agg(F.count("*").alias("n"))


@query("block_split", f"WITH {PTS}, s AS (SELECT DISTINCT session_id, rig_id FROM sessions) SELECT frame_id, CAST(point_idx // (ring_count * 100) AS BIGINT) AS part, count(*) AS n FROM pts JOIN s USING (session_id) JOIN rigs USING (rig_id) GROUP BY 1, 2")
def block_split(spark, d):
    """Returns split after every 100 firings of all rings."""
    rings = read_table(spark, d, "sessions").select("session_id", "rig_id").distinct().join(read_table(spark, d, "rigs"), "rig_id").select("session_id", "ring_count")
    return points(spark, d).join(rings, "session_id").groupBy("frame_id", F.expr("point_idx div (ring_count * 100)").alias("part")).agg(F.count("*").alias("n"))


_KNOWN = ("RSAIRY", "RS16", "RS32", "RSM1", "RSE1")


@query("sensor_models", f"SELECT rig_id, CASE WHEN upper(trim(lidar_type)) IN {_KNOWN} THEN upper(trim(lidar_type)) ELSE 'RSAIRY' END AS model, coalesce(upper(trim(lidar_type)) NOT IN {_KNOWN}, true) AS warning FROM rigs")
def sensor_models(spark, d):
    """Names of sensor models; one that is not known counts as the default, with a warning."""
    model, warning = geo.known_or("lidar_type", _KNOWN, "RSAIRY")
    return read_table(spark, d, "rigs").select("rig_id", model.alias("model"), warning.alias("warning"))


@query("first_camera", "SELECT session_id, cam_id, cam_width FROM (SELECT session_id, cam_id, cam_width, row_number() OVER (PARTITION BY session_id ORDER BY recv_ts, cam_id) AS r FROM cam_signals) WHERE r = 1")
def first_camera(spark, d):
    """The camera message of each session that came first: its width binds the intrinsics."""
    g = read_table(spark, d, "cam_signals").groupBy("session_id").agg(F.min(F.struct("recv_ts", "cam_id", "cam_width")).alias("m"))
    return g.select("session_id", "m.cam_id", "m.cam_width")


_CLOUD = {"x": 7, "y": 7, "z": 7, "intensity": 7, "ring": 4, "point_t": 8}


@query("cloud_roundtrip", f"WITH {PTS} SELECT frame_id, count(*) AS n, {', '.join(f'CAST(sum(CAST(round({c}*10000) AS BIGINT)) AS BIGINT) AS s{c}' for c in 'xyz')}, CAST(sum(ring) AS BIGINT) AS rings, CAST(sum(CAST(round(point_t*1000000) AS BIGINT)) AS BIGINT) AS st FROM ok GROUP BY 1")
def cloud_roundtrip(spark, d):
    """Clouds packed into messages and read again."""
    p = good(spark, d).select("frame_id", "point_idx", "x", "y", "z", "intensity", F.col("ring").cast("bigint").alias("ring"), "point_t")
    packed = encode_points(p, _CLOUD)
    fields, step = layout(_CLOUD)
    g = decode_points(packed, fields, step).groupBy("frame_id")
    return g.agg(F.count("*").alias("n"), *[F.sum(F.round(F.col(c) * 10_000).cast("bigint")).alias(f"s{c}") for c in "xyz"], F.sum("ring").cast("bigint").alias("rings"), F.sum(F.round(F.col("point_t") * 1_000_000).cast("bigint")).alias("st"))


@query("colour_roundtrip", f"WITH {PTS} SELECT point_id, (ring % 256) * 65536 + (point_idx % 256) * 256 + point_id % 256 AS rgb FROM ok")
def colour_roundtrip(spark, d):
    """Colours packed into the bits of a float32 of a message and read again."""
    p = good(spark, d).select("frame_id", "point_idx", F.col("point_id").alias("tag"), (F.col("ring") % 256).alias("r"), (F.col("point_idx") % 256).alias("g"), (F.col("point_id") % 256).alias("b"), F.floor(F.col("point_id") / 1_000_000).cast("int").alias("hi"), (F.col("point_id") % 1_000_000).cast("int").alias("lo"))
    packed = encode_points(p, {"hi": 5, "lo": 5}, rgb=True)
    got = decode_points(packed, {"hi": (0, 5), "lo": (4, 5), "rgb": (8, 5)}, 12)
    return got.select((F.col("hi").cast("bigint") * 1_000_000 + F.col("lo").cast("bigint")).alias("point_id"), F.col("rgb").cast("bigint").alias("rgb"))


_SQL_MESH = f"""{_SQL_TILES}, v AS (SELECT frame_id, i, j, row_number() OVER (PARTITION BY frame_id ORDER BY i, j) - 1 AS id, round(h, 2) AS h FROM g),
q AS (SELECT p.frame_id, p.i, p.j, p.id a, q.id b, r.id c, s.id e, p.h ha, q.h hb, r.h hc, s.h he FROM v p JOIN v q ON q.frame_id=p.frame_id AND q.i=p.i+1 AND q.j=p.j JOIN v r ON r.frame_id=p.frame_id AND r.i=p.i AND r.j=p.j+1 JOIN v s ON s.frame_id=p.frame_id AND s.i=p.i+1 AND s.j=p.j+1),
tri AS (SELECT frame_id, i, j, 0 AS half, a, b, e AS c FROM q WHERE greatest(sqrt(4+(ha-hb)*(ha-hb)), sqrt(4+(hb-he)*(hb-he)), sqrt(8+(ha-he)*(ha-he))) < 4
 UNION ALL SELECT frame_id, i, j, 1, a, e, c FROM q WHERE greatest(sqrt(8+(ha-he)*(ha-he)), sqrt(4+(he-hc)*(he-hc)), sqrt(4+(ha-hc)*(ha-hc))) < 4),
n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY i, j, half) - 1 AS k FROM tri)"""


@query("ply_lines", f"""WITH {_SQL_MESH} SELECT frame_id, 1 AS part, id AS k, format('{{:.2f}} {{:.2f}} {{:.2f}}', i*2.0+1, j*2.0+1, h + 0.0) AS line FROM v
UNION ALL SELECT frame_id, 2, k, format('3 {{}} {{}} {{}}', a, b, c) FROM n
UNION ALL SELECT frame_id, 0, k, CASE k WHEN 0 THEN 'ply' WHEN 1 THEN 'format ascii 1.0' WHEN 2 THEN 'element vertex ' || nv WHEN 3 THEN 'property double x' WHEN 4 THEN 'property double y' WHEN 5 THEN 'property double z' WHEN 6 THEN 'element face ' || nt WHEN 7 THEN 'property list uchar int vertex_indices' ELSE 'end_header' END
 FROM (SELECT frame_id, count(*) AS nv, (SELECT count(*) FROM n WHERE n.frame_id = v.frame_id) AS nt FROM v GROUP BY 1), (SELECT unnest(range(9)) AS k)""")  # fmt: skip
def mesh_lines(spark, d):
    """The mesh of each frame's tiles as lines of a polygon file."""
    w = Window.partitionBy("frame_id").orderBy("i", "j")
    g = _tiles(spark, d).select("frame_id", "i", "j", (F.row_number().over(w) - 1).alias("id"), (F.col("i") * 2.0 + 1).alias("x"), (F.col("j") * 2.0 + 1).alias("y"), (F.round("h", 2) + 0.0).alias("z"))
    t = spa.triangles(g, ["frame_id"], 4.0)
    at = lambda di, dj, n: g.select("frame_id", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("id").alias(n))
    for di, dj, n in ((0, 0, "p"), (1, 0, "q"), (0, 1, "r"), (1, 1, "s")):
        t = t.join(at(di, dj, n), ["frame_id", "i", "j"])
    first = F.col("half") == 0
    w = Window.partitionBy("frame_id").orderBy("i", "j", "half")
    t = t.select("frame_id", (F.row_number().over(w) - 1).alias("k"), F.col("p").alias("a"), F.when(first, F.col("q")).otherwise(F.col("s")).alias("b"), F.when(first, F.col("s")).otherwise(F.col("r")).alias("c"))
    return ply_lines(g.select("frame_id", "id", "x", "y", "z"), t, "frame_id", 2)


@query("map_comparison", f"""WITH {PTS}, {_ORDER}, h AS (SELECT session_id, max(k) AS k FROM f GROUP BY 1), m AS (SELECT ok.* FROM ok JOIN f USING (session_id, frame_id) JOIN h USING (session_id, k))
SELECT 'a' AS map, count(*) AS n, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(z), 5) AS z, 0.2::DOUBLE AS r, 0.4::DOUBLE AS g, 1.0::DOUBLE AS b FROM ok
UNION ALL SELECT 'b', count(*), round(avg(x*cos(0.3) - y*sin(0.3) + 1.5), 5), round(avg(x*sin(0.3) + y*cos(0.3) - 0.5), 5), round(avg(z), 5), 0.1, 0.9, 0.3 FROM m""")  # fmt: skip
def map_comparison(spark, d):
    """All frames beside the last frame of each session, which is moved into their frame; each map in its colour."""
    p = good(spark, d)
    last = _frame_order(spark, d).groupBy("session_id").agg(F.max_by("frame_id", "k").alias("frame_id"))
    c, s = F.cos(F.lit(0.3)), F.sin(F.lit(0.3))
    m = [[c, -s, 0.0, 1.5], [s, c, 0.0, -0.5], [0.0, 0.0, 1.0, 0.0]]
    both = pipelines.compare_maps(p, p.join(last, ["session_id", "frame_id"], "left_semi"), m)
    g = both.groupBy("map").agg(F.count("*").alias("n"), *[F.round(F.avg(v), 5).alias(v) for v in "xyz"], *[F.first(v).alias(v) for v in "rgb"])
    return g


@query("coloured_merge", f"""WITH {PTS}, {_ORDER}, m AS (SELECT session_id, x*cos(0.02*k) - y*sin(0.02*k) + 0.05*k AS x, x*sin(0.02*k) + y*cos(0.02*k) AS y, z + 0.01*k AS z, CASE WHEN isfinite(intensity) THEN intensity/255 END AS r, ring/128.0 AS g, 0.5 AS b FROM ok JOIN f USING (session_id, frame_id))
SELECT session_id, CAST(floor(x/0.5) AS BIGINT) AS vx, CAST(floor(y/0.5) AS BIGINT) AS vy, CAST(floor(z/0.5) AS BIGINT) AS vz, count(*) AS n, {', '.join(f'round(avg({c}), 5) AS {c}' for c in 'xyzrgb')} FROM m GROUP BY 1, 2, 3, 4""")  # fmt: skip
def coloured_merge(spark, d):
    """Frames moved by a transform each and merged by voxel with their colours."""
    a = F.col("k") * 0.02
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(F.cos(a), -F.sin(a), zero, 0.05 * F.col("k"), F.sin(a), F.cos(a), zero, zero, zero, zero, one, 0.01 * F.col("k"))
    p = good(spark, d).withColumns({"r": F.when(geo.finite("intensity"), F.col("intensity") / 255), "g": F.col("ring") / 128.0, "b": F.lit(0.5)})
    merged = pipelines.merge_clouds(p, _frame_order(spark, d).select("frame_id", m.alias("m")), "frame_id", ["session_id"], 0.5, ("r", "g", "b"))
    return _r(merged, *"xyzrgb", k=5)


@query("common_clock", f"""WITH {_ALL_SIGNALS}, t0 AS (SELECT session_id, sensor, min(t) AS t0 FROM u GROUP BY ALL),
s AS (SELECT session_id, coalesce(max(t0) FILTER (sensor = 'camera') - max(t0) FILTER (sensor = 'lidar'), 0) AS epoch FROM t0 GROUP BY 1),
c AS (SELECT session_id, sensor, id, t - CASE WHEN sensor = 'camera' THEN epoch ELSE 0 END AS t, v FROM u JOIN s USING (session_id)),
z AS (SELECT session_id, min(t) AS z FROM c GROUP BY 1) SELECT session_id, sensor, id, t AS t_us, t - z AS rel_us, round(v, 6) AS value FROM c JOIN z USING (session_id)""")  # fmt: skip
def common_clock(spark, d):
    """All three signals on the range clock: the camera's epoch is removed, times count from the earliest stamp of a session."""
    parts = None
    for table, p, name in (("lidar_signals", "lidar", "lidar"), ("cam_signals", "cam", "camera"), ("imu_signals", "imu", "imu")):
        one = read_table(spark, d, table).where(geo.finite(f"{p}_t", f"{p}_v")).select("session_id", F.lit(name).alias("sensor"), F.col(f"{p}_id").alias("id"), _us(f"{p}_t").alias("t"), F.col(f"{p}_v").alias("v")).dropDuplicates(["id"])
        parts = one if parts is None else parts.unionByName(one)
    out = ser.on_common_clock(parts, ["session_id"], "sensor", "t", "camera", "lidar")
    return _r(out.select("session_id", "sensor", "id", F.col("t").alias("t_us"), F.col("rel").alias("rel_us"), F.col("v").alias("value")), "value")


@query("double_integral", f"""WITH {LID}, {VAL}, a AS (SELECT session_id, lidar_id, t, coalesce((v + lag(v) OVER o)/2*(t - lag(t) OVER o)/1e6, 0) AS a FROM val WINDOW o AS (PARTITION BY session_id ORDER BY t, lidar_id)),
b AS (SELECT session_id, lidar_id, t, sum(a) OVER (PARTITION BY session_id ORDER BY t, lidar_id) AS b FROM a), c AS (SELECT session_id, lidar_id, t, coalesce((b + lag(b) OVER o)/2*(t - lag(t) OVER o)/1e6, 0) AS c FROM b WINDOW o AS (PARTITION BY session_id ORDER BY t, lidar_id))
SELECT lidar_id, round(sum(c) OVER (PARTITION BY session_id ORDER BY t, lidar_id), 3) AS area FROM c""")  # fmt: skip
def double_integral(spark, d):
    """The range integrated twice by trapezoids."""
    return _r(ser.integral(_valued(spark, d), ["session_id"], "v", "area", times=2).select("lidar_id", "area"), "area", k=3)


def _sql_savgol(win: int, deriv: int) -> str:
    h = win // 2
    s0, s2, s4 = (sum(j**k for j in range(-h, h + 1)) for k in (0, 2, 4))
    w = {j: j / s2 if deriv == 1 else 2 * (s0 * j * j - s2) / (s0 * s4 - s2 * s2) for j in range(-h, h + 1)}
    return " + ".join(f"({w[j]!r})*{'v' if j == 0 else f'lead(v, {j}) OVER o' if j > 0 else f'lag(v, {-j}) OVER o'}" for j in w)


@query("savgol_derivatives", f"WITH {LID}, {VAL} SELECT lidar_id, round({_sql_savgol(9, 1)}, 6) AS slope, round({_sql_savgol(7, 2)}, 6) AS bend FROM val WINDOW o AS (PARTITION BY session_id ORDER BY t, lidar_id)")
def savgol_derivatives(spark, d):
    """First derivative over 9 and second over 7 samples (second degree, per sample); null near the ends."""
    out = ser.windowed(_valued(spark, d), ["session_id"], {"slope": ser.savgol("v", 9, 1), "bend": ser.savgol("v", 7, 2)}, 4, 4)
    return _r(out.select("lidar_id", "slope", "bend"), "slope", "bend")


@query("renamed_labels", "SELECT session_id, coalesce(lidar_type, rig_id) AS label FROM (SELECT DISTINCT session_id, rig_id FROM sessions) LEFT JOIN (SELECT rig_id, lidar_type FROM rigs WHERE rig_id <> 'RIG-07') USING (rig_id)")
def renamed_labels(spark, d):
    """Rigs renamed to their sensor; one that has no new name keeps its old one."""
    names = {r["rig_id"]: r["lidar_type"] for r in read_table(spark, d, "rigs").where("rig_id <> 'RIG-07'").collect()}  # a list of forty
    s = read_table(spark, d, "sessions").select("session_id", F.col("rig_id").alias("label")).distinct()
    return pipelines.relabel(s, "label", names)[0]


@query("ring_circles", f"""WITH {PTS}, s AS (SELECT frame_id, ring, x, y FROM ok), f AS (SELECT frame_id, ring, count(*) n, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(x*y) sxy, sum(y*y) syy, sum(x*x+y*y) sz, sum(x*(x*x+y*y)) sxz, sum(y*(x*x+y*y)) syz FROM s GROUP BY 1, 2),
d AS (SELECT *, sxx*(syy*n-sy*sy) - sxy*(sxy*n-sy*sx) + sx*(sxy*sy-syy*sx) AS det FROM f),
p AS (SELECT frame_id, ring, n, (sxz*(syy*n-sy*sy) - sxy*(syz*n-sy*sz) + sx*(syz*sy-syy*sz))/det/2 AS cx, (sxx*(syz*n-sz*sy) - sxz*(sxy*n-sy*sx) + sx*(sxy*sz-syz*sx))/det/2 AS cy, (sxx*(syy*sz-syz*sy) - sxy*(sxy*sz-syz*sx) + sxz*(sxy*sy-syy*sx))/det AS c FROM d WHERE abs(det) > 1e-9 AND n >= 12),
r AS (SELECT frame_id, ring, n, cx, cy, sqrt(c + cx*cx + cy*cy) AS r FROM p WHERE c + cx*cx + cy*cy > 0),
e AS (SELECT frame_id, ring, avg(abs(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) - r)) AS err FROM s JOIN r USING (frame_id, ring) GROUP BY 1, 2)
SELECT frame_id, ring, n, round(r, 3) AS r, round(err, 3) AS err FROM r JOIN e USING (frame_id, ring) WHERE abs(r - 20) <= 6 AND err <= 20/6.0""")  # fmt: skip
def ring_circles(spark, d):
    """Circles through each ring of a frame that are plausible: radius within 0.3 of 20 m, mean radial error within a sixth."""
    out = spa.plausible_circles(good(spark, d).select("frame_id", "ring", "x", "y"), ["frame_id", "ring"], 20.0, 12)
    return _r(out.select("frame_id", "ring", "n", "r", "err"), "r", "err", k=3)


@query("message_log", """SELECT session_id, severity, code, count(*) AS n FROM (
SELECT DISTINCT session_id, lidar_id AS id, 'WARNING' AS severity, 'no stamp' AS code FROM lidar_signals WHERE lidar_t IS NULL
UNION ALL SELECT DISTINCT session_id, lidar_id, 'ERROR', 'no value' FROM lidar_signals WHERE lidar_v IS NULL OR isnan(lidar_v)
UNION ALL SELECT DISTINCT session_id, lidar_id, 'INFO', 'repeated' FROM (SELECT session_id, lidar_id FROM lidar_signals GROUP BY 1, 2 HAVING count(*) > 1)) GROUP BY ALL""")  # fmt: skip
def message_log(spark, d):
    """Faults of the range messages by severity."""
    t = read_table(spark, d, "lidar_signals").groupBy("session_id", "lidar_id").agg(F.max(F.col("lidar_t").isNull()).alias("t"), F.max(F.col("lidar_v").isNull() | F.isnan("lidar_v")).alias("v"), F.count("*").alias("k"))
    faults = F.array(
        F.when(F.col("t"), F.struct(F.lit("WARNING").alias("severity"), F.lit("no stamp").alias("code"))),
        F.when(F.col("v"), F.struct(F.lit("ERROR").alias("severity"), F.lit("no value").alias("code"))),
        F.when(F.col("k") > 1, F.struct(F.lit("INFO").alias("severity"), F.lit("repeated").alias("code"))),
    )
    return t.select("session_id", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("f")).groupBy("session_id", "f.severity", "f.code").agg(F.count("*").alias("n"))


@query("grid_function", f"WITH {PTS}, e AS (SELECT session_id, CAST(floor((min(x)-1)/8) AS BIGINT) i0, CAST(ceil((max(x)+1)/8) AS BIGINT) i1, CAST(floor((min(y)-1)/8) AS BIGINT) j0, CAST(ceil((max(y)+1)/8) AS BIGINT) j1 FROM ok GROUP BY 1), g AS (SELECT session_id, unnest(range(i0, i1)) AS i, j0, j1 FROM e) SELECT session_id, i, unnest(range(j0, j1)) AS j FROM g")
def grid_function(spark, d):
    """A grid of 8 m over each session's extent with a margin of 1 m, by a table function from SQL."""
    spa.register_grid_function(spark)
    good(spark, d).groupBy("session_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).createOrReplaceTempView("grid_extents")
    return spark.sql("SELECT e.session_id, g.i, g.j FROM grid_extents e, LATERAL grid_cells(e.x0, e.x1, e.y0, e.y1, 8.0D, 1.0D) g")


@query("frame_fitness", f"""WITH {PTS}, {_ORDER}, p AS (SELECT session_id, k, point_id, x, y, z FROM ok JOIN f USING (session_id, frame_id)),
m AS (SELECT a.session_id, a.k, a.point_id, min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d2 FROM p a JOIN p b ON a.session_id = b.session_id AND b.k = a.k - 1 AND abs(a.x-b.x) <= 0.3 AND abs(a.y-b.y) <= 0.3 AND abs(a.z-b.z) <= 0.3 GROUP BY 1, 2, 3)
SELECT session_id, CAST(k AS BIGINT) AS k, count(*) AS n, round(count(*) FILTER (d2 <= 0.3*0.3) / count(*), 6) AS fitness, round(sqrt(avg(d2) FILTER (d2 <= 0.3*0.3)), 6) AS rmse FROM p LEFT JOIN m USING (session_id, k, point_id) WHERE k > 0 GROUP BY 1, 2""")  # fmt: skip
def frame_fitness(spark, d):
    """Share of each frame's points that have one of the frame before within 0.3 m, and their root mean square distance."""
    p = good(spark, d).join(_frame_order(spark, d), ["session_id", "frame_id"]).select("session_id", F.col("k").cast("bigint").alias("k"), F.col("point_id").alias("id"), "x", "y", "z")
    b = p.withColumn("k", F.col("k") + 1)
    near = fit.closest_points(p.where("k > 0"), b, 0.3, ["session_id", "k"]).select("id", "d2")
    g = p.where("k > 0").join(near, "id", "left").groupBy("session_id", "k")
    return _r(g.agg(F.count("*").alias("n"), (F.count("d2") / F.count("*")).alias("fitness"), F.sqrt(F.avg("d2")).alias("rmse")), "fitness", "rmse")


@query("surface_tiles", f"""WITH {PTS}, pl AS (SELECT frame_id, 0 AS plane, -min(z) AS d FROM ok GROUP BY 1), n AS (SELECT frame_id, plane, y AS pu, -x AS pv, z + d AS h, CASE WHEN isfinite(intensity) THEN intensity/255 END AS r FROM ok JOIN pl USING (frame_id) WHERE abs(z + d) < 0.25),
t AS (SELECT frame_id, plane, unnest(range(CAST(ceil((pu-0.5)/0.5) AS BIGINT), CAST(floor((pu+0.5)/0.5) AS BIGINT)+1)) AS i, pu, pv, h, r FROM n),
s AS (SELECT frame_id, plane, i, unnest(range(CAST(ceil((pv-0.5)/0.5) AS BIGINT), CAST(floor((pv+0.5)/0.5) AS BIGINT)+1)) AS j, pu - i*0.5 AS dx, pv, h, r FROM t),
w AS (SELECT frame_id, plane, i, j, dx, pv - j*0.5 AS dy, h, r, 1/(dx*dx + (pv - j*0.5)*(pv - j*0.5) + 1e-9) AS w FROM s)
SELECT frame_id, plane, i, j, count(*) AS n, round(avg(dx), 5) AS mx, round(sum(w*r)/sum(w), 5) AS r FROM w GROUP BY ALL HAVING count(*) >= 4""")  # fmt: skip
def floor_tiles(spark, d):
    """A vertex every half metre of each frame's floor, from all points within half a metre along either axis."""
    p = good(spark, d).withColumns({"r": F.when(geo.finite("intensity"), F.col("intensity") / 255)})
    planes = p.groupBy("frame_id").agg((-F.min("z")).alias("d")).select("frame_id", F.lit(0).alias("plane"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("c"), "d")
    out = pipelines.surface_tiles(p, planes, ["frame_id"], 0.25, 0.5, 0.5)
    return _r(out.select("frame_id", "plane", "i", "j", "n", "mx", "r"), "mx", "r", k=5)
