"""Groups of points cut into leaves: whole groups where they are small, else cells of halved sides.

A leaf is a box that no other leaf of its group enters, so a point whose ball lies inside the box can have no
neighbour in another leaf. Leaves follow from counts alone: the same points give the same leaves whatever the
number of partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.session import materialize

CAP = 32_768
SIDES = (64.0, 32.0, 16.0, 8.0, 4.0, 2.0)
LEAF = ["grp", "depth", "lx", "ly", "lz", "part"]


def with_leaves(points: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds depth, lx, ly, lz, part to grp, id, x, y, z. Depth 0 is the whole group (at most ``cap`` rows); depth d a
    cell of side ``SIDES[d - 1]``, the largest that holds at most ``cap`` rows. A cell of the smallest side that still holds
    more is shared out by hashed id (part > 0); such leaves overlap and all their points are open."""
    whole = dict.fromkeys(LEAF[1:], F.lit(0).cast("bigint"))
    sizes = points.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("grp")
    large = materialize(sizes, "large")
    if large.isEmpty():
        return points.withColumns(whole)
    fine = {f"f{c}": F.floor(F.col(c).cast("double") / SIDES[-1]) for c in "xyz"}
    cells = materialize(points.join(large, "grp", "left_semi").withColumns(fine).groupBy("grp", *fine).agg(F.count("*").alias("n")), "cells")
    up = [F.struct(F.lit(d).cast("bigint").alias("depth"), *[F.floor(F.col(f"f{c}") / F.lit(s / SIDES[-1])).alias(f"l{c}") for c in "xyz"]) for d, s in enumerate(SIDES, 1)]
    above = cells.select("grp", *fine, "n", F.explode(F.array(*up)).alias("a")).select("grp", *fine, "n", "a.*")
    held = above.groupBy("grp", "depth", "lx", "ly", "lz").agg(F.sum("n").alias("held"))
    chosen = (
        above.join(held, ["grp", "depth", "lx", "ly", "lz"]).where((F.col("held") <= cap) | (F.col("depth") == len(SIDES)))
        .groupBy("grp", *fine).agg(F.min(F.struct("depth", "lx", "ly", "lz", F.ceil(F.col("held") / F.lit(cap)).alias("parts"))).alias("leaf"))
    )
    placed = points.withColumns(fine).join(materialize(chosen, "leaves"), ["grp", *fine], "left").drop(*fine)
    share = F.when(F.col("leaf.parts") > 1, F.pmod(F.xxhash64("id"), F.col("leaf.parts")) + 1)
    made = {c: F.coalesce(F.col(f"leaf.{c}"), F.lit(0)) for c in LEAF[1:-1]}
    return placed.withColumns({**made, "part": F.coalesce(share, F.lit(0))}).drop("leaf")


def leaf_box(depth: int, cell: tuple[int, int, int], part: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corner; infinite for a whole group, empty for a shared cell."""
    if depth == 0:
        return np.full(3, -np.inf), np.full(3, np.inf)
    if part:
        return np.full(3, np.inf), np.full(3, -np.inf)
    lo = np.array(cell, float) * SIDES[depth - 1]
    return lo, lo + SIDES[depth - 1]


def leaves_box(x: np.ndarray, reach: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Points whose ball of radius ``reach`` leaves the box."""
    r = reach[:, None]
    return ((x - r < lo) | (x + r >= hi)).any(axis=1)
