"""Nearest record in time for the same entity: hashed Arrow groups, DuckDB ASOF joins inside each.

Both sides are cut into (entity, time slice) cells; right rows within the tolerance of a slice's edge are
copied to the neighbouring slice, so every cell can be answered on its own. Cells are hashed into groups of
bounded size, so a recording holding a third of all rows is spread over all groups. Inside a group one
backward and one forward ASOF join give at most two candidates per left row, of which the nearer stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_A_GROUP = 150_000

_ASOF = """
WITH r AS (SELECT e, s, t, min(id) AS id FROM right_rows GROUP BY e, s, t),
l AS (SELECT DISTINCT e, s, t, id FROM left_rows),
both_ways AS (
  SELECT l.id AS left_id, r.id AS right_id, l.t - r.t AS gap, 0 AS later
    FROM l ASOF JOIN r ON l.e = r.e AND l.s = r.s AND l.t >= r.t
  UNION ALL
  SELECT l.id, r.id, r.t - l.t, 1
    FROM l ASOF JOIN r ON l.e = r.e AND l.s = r.s AND l.t <= r.t
)
SELECT left_id, arg_min(right_id, gap * 2 + later) AS right_id, min(gap) AS gap_us
  FROM both_ways WHERE gap <= {tolerance} GROUP BY left_id
"""


def _matcher(tolerance_us: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("gap_us", pa.int64())])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        try:
            con.register("left_rows", left)
            con.register("right_rows", right)
            return con.sql(_ASOF.format(tolerance=tolerance_us)).to_arrow_table().cast(schema)
        finally:
            con.close()

    return match


def nearest_in_time(
    left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, left_t: str, right_t: str, entity: str,
    tolerance_us: int, slice_us: int = 10_000_000, groups: int | None = None,
) -> DataFrame:
    """left_id, right_id, gap_us: for each left row the right row of the same entity nearest in time, if at
    most ``tolerance_us`` away (bound included). Times are bigint microseconds; ids bigint.

    Ties: of two right rows equally far the earlier one; of equal times the smaller id. Repeated rows count
    once. A null entity, time or id matches nothing; empty sides give no rows. Other columns, whatever their
    names, are ignored.
    """
    pick = lambda df, e, t, i: df.select(F.col(e).alias("e"), F.col(t).cast("bigint").alias("t"), F.col(i).cast("bigint").alias("id")).dropna()
    if groups is None:
        groups = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((left.count() + right.count()) / ROWS_A_GROUP))
    cell = lambda df: df.withColumn("g", F.pmod(F.xxhash64("e", "s"), F.lit(groups)).cast("int"))
    at = lambda x: F.floor(x / F.lit(slice_us)).cast("bigint")
    lhs = cell(pick(left, entity, left_t, left_id).withColumn("s", at(F.col("t"))))
    wide = pick(right, entity, right_t, right_id)
    rhs = cell(wide.withColumn("s", F.explode(F.sequence(at(F.col("t") - tolerance_us), at(F.col("t") + tolerance_us)))))
    return (
        lhs.groupBy("g").cogroup(rhs.groupBy("g"))
        .applyInArrow(_matcher(tolerance_us), "left_id bigint, right_id bigint, gap_us bigint")
    )
