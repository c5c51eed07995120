"""Time series cut into blocks of bounded duration, each with readings of its neighbours as context.

A series (one recording and channel, say) may hold any share of all rows, so no operator here takes a
whole series into one task. Rows are grouped by series *and* time block; what crosses a block's edges is
carried by short context arrays made from block-level rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

READING = "array<struct<t:bigint,id:bigint,v:double>>"


def usable(v: str) -> F.Column:
    """Not null and finite."""
    c = F.col(v).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def pack_blocks(readings: DataFrame, keys: list[str], block_us: int) -> DataFrame:
    """``readings``: ``keys``, t (bigint, microseconds or finer), id, v; rows with null t or unusable v are
    dropped, equal rows count once. Out: keys, block, rs (readings sorted by time, then id)."""
    rows = readings.where(F.col("t").isNotNull() & usable("v"))
    return (
        rows.withColumn("block", F.floor(F.col("t") / F.lit(block_us)).cast("bigint"))
        .groupBy(*keys, "block")
        .agg(F.sort_array(F.collect_set(F.struct("t", "id", "v"))).alias("rs"))
    )


def block_context(blocks: DataFrame, keys: list[str], size: int, reach: int | None = None) -> DataFrame:
    """For each block: ``prev``, the last ``size`` readings before it, and ``next``, the first ``size``
    after it, in whichever blocks they lie. Every stored block has a reading, so ``size`` blocks each way
    are enough; with ``reach`` only so many blocks each way are looked at. Works on edges only; the blocks' own readings don't
    move."""
    reach = reach or size
    w = Window.partitionBy(*keys).orderBy("block")
    edges = blocks.select(
        *keys,
        "block",
        F.expr(f"slice(rs, greatest(size(rs) - {size} + 1, 1), {size})").alias("tail"),
        F.slice("rs", 1, size).alias("head"),
    )
    before = F.flatten(F.collect_list("tail").over(w.rowsBetween(-reach, -1)))
    after = F.flatten(F.collect_list("head").over(w.rowsBetween(1, reach)))
    return edges.select(*keys, "block", before.alias("b"), after.alias("a")).select(
        *keys,
        "block",
        F.expr(f"slice(b, greatest(size(b) - {size} + 1, 1), {size})").alias("prev"),
        F.slice("a", 1, size).alias("next"),
    )
