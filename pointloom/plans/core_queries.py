"""Queries of the two general problems: implausible readings (p2) and regular series (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.regrid import regular_series
from pointloom.operators.spikes import implausible_readings
from pointloom.session import read_table

GRAVITY = 9.80665
SLOTS = {"lidar": 500_000, "imu": 250_000}


def _micros(column: str) -> F.Column:
    """Seconds as double → whole microseconds; NaN and infinities become null."""
    c = F.col(column)
    return F.when(~F.isnan(c) & (F.abs(c) < 9e12), F.round(c * 1_000_000).cast("bigint"))


def signal_readings(spark: SparkSession, d: str) -> DataFrame:
    """session_id, channel, t, id, v of the range and inertial signals."""
    lidar = read_table(spark, d, "lidar_signals").select(
        "session_id", F.lit("lidar_v").alias("channel"), _micros("lidar_t").alias("t"), F.col("lidar_id").alias("id"), F.col("lidar_v").alias("v")
    )
    imu = read_table(spark, d, "imu_signals").select(
        "session_id", F.lit("imu_v").alias("channel"), _micros("imu_t").alias("t"), F.col("imu_id").alias("id"), F.col("imu_v").alias("v")
    )
    return lidar.unionByName(imu)


def channel_readings(spark: SparkSession, d: str) -> DataFrame:
    """session_id, channel, t, id, v of all five channels."""
    parts = [F.struct(F.lit(f"acc_{a}").alias("channel"), F.col(f"linear_acceleration.{a}").alias("v")) for a in "xyz"]
    acc = (
        read_table(spark, d, "imu_messages")
        .select("session_id", F.col("stamp_ns").alias("t"), F.col("msg_id").alias("id"), F.explode(F.array(*parts)).alias("c"))
        .select("session_id", "c.channel", F.expr("t div 1000").alias("t"), "id", "c.v")
    )
    return signal_readings(spark, d).unionByName(acc)


def channel_limits(spark: SparkSession, d: str) -> DataFrame:
    """session_id, channel, lo, hi from the rig of the session."""
    s = read_table(spark, d, "sessions").select("session_id", "rig_id").distinct()
    r = read_table(spark, d, "rigs")
    acc = F.col("acc_range_g") * F.when(F.col("imu_unit") == "m/s2", F.lit(GRAVITY)).otherwise(F.lit(1.0))
    imu = F.col("acc_range_g") * GRAVITY
    rows = [("lidar_v", F.col("min_distance"), F.col("max_distance")), ("imu_v", -imu, imu)] + [(f"acc_{a}", -acc, acc) for a in "xyz"]
    bounds = F.array(*[F.struct(F.lit(c).alias("channel"), lo.alias("lo"), hi.alias("hi")) for c, lo, hi in rows])
    return s.join(r, "rig_id").select("session_id", F.explode(bounds).alias("b")).select("session_id", "b.*")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(channel_readings(spark, d), channel_limits(spark, d))


def p5_series(spark: SparkSession, d: str) -> DataFrame:
    """The regular series: value, uncertainty, number of readings and missing mark of every slot."""
    readings = signal_readings(spark, d).withColumn("sensor", F.substring_index("channel", "_", 1)).drop("channel")
    return regular_series(readings, SLOTS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_series(spark, d).where("missing").select("sensor", "session_id", "slot")


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_series": p5_series}

_READINGS = """
  SELECT DISTINCT session_id, 'lidar_v' AS channel, lidar_t AS t, lidar_id AS id, lidar_v AS v FROM lidar_signals
   WHERE lidar_t IS NOT NULL AND isfinite(lidar_t) AND lidar_v IS NOT NULL AND isfinite(lidar_v)
  UNION ALL
  SELECT DISTINCT session_id, 'imu_v', imu_t, imu_id, imu_v FROM imu_signals
   WHERE imu_t IS NOT NULL AND isfinite(imu_t) AND imu_v IS NOT NULL AND isfinite(imu_v)
"""
_ACC = " ".join(
    f"""UNION ALL SELECT DISTINCT session_id, 'acc_{a}', CAST(stamp_ns AS DOUBLE), msg_id, linear_acceleration.{a} FROM imu_messages
   WHERE stamp_ns IS NOT NULL AND linear_acceleration.{a} IS NOT NULL AND isfinite(linear_acceleration.{a})"""
    for a in "xyz"
)

ORACLES = {
    "p2_found": f"""
WITH r AS ({_READINGS} {_ACC}),
lim AS (SELECT s.session_id, g.min_distance, g.max_distance, g.acc_range_g, g.imu_unit
        FROM (SELECT DISTINCT session_id, rig_id FROM sessions) s JOIN rigs g USING (rig_id)),
o AS (SELECT *, row_number() OVER w AS k,
        lag(v, 1) OVER w AS b1, lag(v, 2) OVER w AS b2, lag(v, 3) OVER w AS b3,
        lead(v, 1) OVER w AS a1, lead(v, 2) OVER w AS a2, lead(v, 3) OVER w AS a3,
        abs(v - lag(v, 1) OVER w) AS d
      FROM r WINDOW w AS (PARTITION BY session_id, channel ORDER BY t, id)),
m AS (SELECT session_id, channel, median(d) AS mad FROM o GROUP BY ALL),
runs AS (SELECT *, sum(CASE WHEN v = b1 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, channel ORDER BY k) AS run FROM o),
x AS (SELECT runs.*, count(*) OVER (PARTITION BY runs.session_id, runs.channel, run) AS run_n, 12 * mad AS lim
      FROM runs JOIN m ON runs.session_id = m.session_id AND runs.channel = m.channel)
SELECT x.id AS sample_id, x.channel
FROM x LEFT JOIN lim l ON x.session_id = l.session_id
WHERE run_n >= 8
   OR (x.channel = 'lidar_v' AND (v < min_distance OR v > max_distance))
   OR (x.channel = 'imu_v' AND abs(v) > acc_range_g * 9.80665)
   OR (x.channel LIKE 'acc_%' AND abs(v) > acc_range_g * (CASE WHEN imu_unit = 'm/s2' THEN 9.80665 ELSE 1.0 END))
   OR (abs(v-b1) > x.lim AND abs(v-a1) > x.lim AND abs(b1-a1) < x.lim)
   OR (abs(v-b1) > x.lim AND abs(v-a2) > x.lim AND abs(a1-b1) > x.lim AND abs(a1-a2) > x.lim AND abs(b1-a2) < x.lim)
   OR (abs(v-b2) > x.lim AND abs(v-a1) > x.lim AND abs(b1-b2) > x.lim AND abs(b1-a1) > x.lim AND abs(b2-a1) < x.lim)
   OR (abs(v-b1) > x.lim AND abs(v-a3) > x.lim AND abs(a1-b1) > x.lim AND abs(a1-a3) > x.lim AND abs(a2-b1) > x.lim AND abs(a2-a3) > x.lim AND abs(b1-a3) < x.lim)
   OR (abs(v-b2) > x.lim AND abs(v-a2) > x.lim AND abs(b1-b2) > x.lim AND abs(b1-a2) > x.lim AND abs(a1-b2) > x.lim AND abs(a1-a2) > x.lim AND abs(b2-a2) < x.lim)
   OR (abs(v-b3) > x.lim AND abs(v-a1) > x.lim AND abs(b1-b3) > x.lim AND abs(b1-a1) > x.lim AND abs(b2-b3) > x.lim AND abs(b2-a1) > x.lim AND abs(b3-a1) < x.lim)
""",
    "p5_found": f"""
WITH r AS (SELECT split_part(channel, '_', 1) AS sensor, session_id,
             CAST(floor(CAST(round(t * 1000000) AS BIGINT) / (CASE channel WHEN 'lidar_v' THEN 500000 ELSE 250000 END)) AS BIGINT) AS slot
           FROM ({_READINGS})),
e AS (SELECT sensor, session_id, min(slot) AS lo, max(slot) AS hi FROM r GROUP BY ALL),
g AS (SELECT sensor, session_id, unnest(range(lo, hi + 1)) AS slot FROM e)
SELECT g.sensor, g.session_id, g.slot FROM g ANTI JOIN r ON g.sensor = r.sensor AND g.session_id = r.session_id AND g.slot = r.slot
""",
}
