"""Voxels, tiles, radius neighbours and small fits over point tables, as grouped expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import finite, solve3
from pointloom.session import materialize


def valid(df: DataFrame) -> DataFrame:
    return df.where(finite("x", "y", "z") & ((F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)))


def cell(v: str | Column, size: float) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.floor(c.cast("double") / F.lit(float(size))).cast("bigint")


def voxel_mean(df: DataFrame, keys: list[str], size: float, means: list[str]) -> DataFrame:
    """One row per occupied voxel: means of the columns and the number of points; combined before the shuffle."""
    vox = df.select(*keys, *[cell(c, size).alias(f"v{c}") for c in "xyz"], *means)
    return vox.groupBy(*keys, "vx", "vy", "vz").agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in means], F.count("*").alias("n"))


def voxel_first(df: DataFrame, keys: list[str], size: float, order: str, keep: list[str]) -> DataFrame:
    """The first row by ``order`` in each two-dimensional cell: a minimum of structs, no window."""
    vox = df.select(*keys, cell("x", size).alias("vx"), cell("y", size).alias("vy"), F.struct(order, *keep).alias("s"))
    return vox.groupBy(*keys, "vx", "vy").agg(F.min("s").alias("s")).select(*keys, "vx", "vy", "s.*")


def tiles_with_halo(df: DataFrame, side: float, halo: float) -> DataFrame:
    """Adds tx, ty, tz and own: each point in its own tile and again in those it lies within ``halo`` of."""
    for c in "xyz":
        lo, hi = F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)
        df = df.withColumn(f"t{c}", F.explode(F.sequence(lo, hi)))
    own = F.lit(True)
    for c in "xyz":
        own = own & (F.col(f"t{c}") == F.floor(F.col(c) / side))
    return df.withColumn("own", own)


CROWDED, PAIRS_AT_ONCE = 50_000, 1_000_000


def radius_counts(df: DataFrame, keys: list[str], id: str, radius: float) -> DataFrame:
    """keys, id, neighbours: number of other points within ``radius``.

    Points are counted inside tiles of 64 radii with the points around them, few of which lie in two; tiles lie one after the
    other in a partition and are counted many at a time. Where a tile holds more than ``CROWDED`` points, those meet the 27 cells
    around theirs by joins instead, so that no task gets a crowded place whole."""
    pts = df.select(*keys, id, *[F.col(c).cast("double").alias(c) for c in "xyz"])
    side, halo, tile = 64 * radius, radius * (1 + 1e-9), ["tx", "ty", "tz"]
    placed = tiles_with_halo(pts, side, halo)
    crowded = materialize(placed.groupBy(*keys, *tile).agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).drop("n"), "crowded")
    types = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + f"{id} {df.schema[id].dataType.simpleString()}, neighbours bigint"
    dense = not crowded.isEmpty()
    thin = placed.join(crowded, [*keys, *tile], "left_anti") if dense else placed
    group = [*keys, *tile]

    def groups(table: pa.Table) -> np.ndarray:
        """Number of each row's tile, from 0, in the order of rows."""
        new = np.zeros(table.num_rows, bool)
        for name in group:
            code = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new)

    def counted(table: pa.Table, code: np.ndarray) -> list[pa.RecordBatch]:
        column = lambda c: table[c].to_numpy()
        own = column("own").astype(bool)
        corner = np.stack([column(c) for c in tile], axis=1) * side - halo
        n = near_counts(np.stack([column(c) for c in "xyz"], axis=1), code, own, corner, radius)
        return table.select([*keys, id]).filter(pa.array(own)).append_column("neighbours", pa.array(n)).to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CROWDED:
                continue
            table = pa.Table.from_batches(held)
            code = groups(table)
            end = int(np.searchsorted(code, code[-1]))  # the last tile may go on in the next batch
            if end:
                yield from counted(table.slice(0, end), code[:end])
            held = table.slice(end).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield from counted(table, groups(table))

    few = thin.repartition(*group).sortWithinPartitions(*group).mapInArrow(count, types)
    if not dense:
        return few
    return few.unionByName(_crowded_counts(placed.join(crowded, group, "left_semi"), group, id, radius).select(*keys, id, "neighbours"))


def near_counts(x: np.ndarray, group: np.ndarray, own: np.ndarray, corner: np.ndarray, radius: float) -> np.ndarray:
    """Other points of the same group within ``radius`` of each point of ``own``: cells of the radius from the group's corner,
    three cells along z at a time, so many pairs at once."""
    c = np.floor((x - corner) / (radius * (1 + 1e-6))).astype(np.int64) + 1
    n = int(c.max()) + 3
    key = ((group * n + c[:, 0]) * n + c[:, 1]) * n + c[:, 2]
    order = np.argsort(key, kind="stable")
    at, x, me = key[order], x[order], np.flatnonzero(own[order])
    total = np.zeros(len(me), np.int64)
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            k = at[me] + (dx * n + dy) * n
            lo, hi = np.searchsorted(at, k - 1, "left"), np.searchsorted(at, k + 1, "right")
            upto = np.r_[0, np.cumsum(hi - lo)]
            a = 0
            while a < len(me):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS_AT_ONCE, "right")) - 1)
                m = (hi - lo)[a:b]
                row = np.repeat(np.arange(a, b), m)
                there = np.repeat(lo[a:b] - (upto[a:b] - upto[a]), m) + np.arange(upto[b] - upto[a])
                d = x[there] - x[me[row]]
                total[a:b] += np.bincount(row[(d * d).sum(axis=1) <= radius * radius] - a, minlength=b - a)
                a = b
    out = np.zeros(len(x), np.int64)
    out[order[me]] = total - 1
    return out[own]


def _crowded_counts(pts: DataFrame, keys: list[str], id: str, radius: float) -> DataFrame:
    """keys, id, neighbours of the points marked own, by joins of cells; a cell's points travel as arrays of at most 512."""
    pts = pts.withColumns({f"c{c}": cell(c, radius) for c in "xyz"})
    part = F.pmod(F.xxhash64(id), F.lit(1 << 20))
    sizes = pts.groupBy(*keys, "cx", "cy", "cz").agg(F.ceil(F.count("*") / 512).alias("parts"))
    packed = (
        pts.join(sizes, [*keys, "cx", "cy", "cz"]).withColumn("part", part % F.col("parts"))
        .groupBy(*keys, "cx", "cy", "cz", "part").agg(F.collect_list(F.struct("x", "y", "z")).alias("them"))
    )
    around = packed
    for c in ("cx", "cy", "cz"):
        around = around.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    near = lambda p: (p["x"] - F.col("x")) * (p["x"] - F.col("x")) + (p["y"] - F.col("y")) * (p["y"] - F.col("y")) + (p["z"] - F.col("z")) * (p["z"] - F.col("z")) <= radius * radius
    hits = pts.where("own").join(around, [*keys, "cx", "cy", "cz"]).select(*keys, id, F.size(F.filter("them", near)).alias("k"))
    return hits.groupBy(*keys, id).agg((F.sum("k") - 1).alias("neighbours"))


def plane_fit(df: DataFrame, keys: list[str], eps: float = 1e-9) -> DataFrame:
    """Least squares z = a·x + b·y + c per group from nine sums; null coefficients where the points lie in a
    line. ``x``, ``y``, ``z`` should be near 0 for accuracy."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    sums = {"sx": x, "sy": y, "sz": z, "sxx": x * x, "sxy": x * y, "syy": y * y, "sxz": x * z, "syz": y * z}
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])
    c = F.col
    abc = solve3([[c("sxx"), c("sxy"), c("sx")], [c("sxy"), c("syy"), c("sy")], [c("sx"), c("sy"), c("n").cast("double")]], [c("sxz"), c("syz"), c("sz")], eps)
    return s.select(*keys, "n", *[e.alias(k) for e, k in zip(abc, ("a", "b", "c"), strict=True)])


def circle_fit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Algebraic (Kåsa) circle per group: cx, cy, r; null where there is none."""
    x, y = F.col("x"), F.col("y")
    q = x * x + y * y
    sums = {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y, "sq": q, "sxq": x * q, "syq": y * q}
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])
    c = F.col
    p = solve3([[c("sxx"), c("sxy"), c("sx")], [c("sxy"), c("syy"), c("sy")], [c("sx"), c("sy"), c("n").cast("double")]], [c("sxq"), c("syq"), c("sq")], 1e-9)
    r2 = p[2] + p[0] * p[0] / 4 + p[1] * p[1] / 4
    return s.select(*keys, "n", (p[0] / 2).alias("cx"), (p[1] / 2).alias("cy"), F.when(r2 > 0, F.sqrt(F.when(r2 > 0, r2))).alias("r"))


def moments(df: DataFrame, keys: list[str], a: list[str], b: list[str]) -> DataFrame:
    """Counts, means and cross sums for a rigid fit of columns ``a`` onto ``b``: all a solver needs."""
    agg = [F.count("*").alias("n")] + [F.avg(c).alias(f"m_{c}") for c in (*a, *b)]
    agg += [F.sum(F.col(p) * F.col(q)).alias(f"s_{p}_{q}") for p in a for q in b]
    return df.groupBy(*keys).agg(*agg)


def mutual_nearest(a: DataFrame, b: DataFrame, keys: list[str], t: str, id: str, reach: int) -> DataFrame:
    """keys, a_id, b_id, gap, diff (time of b less that of a): pairs that are each other's nearest in time, at most ``reach``
    apart; of equal gaps the smaller id. Times meet in bins of the reach's width."""
    at = lambda c: F.floor(c / F.lit(reach)).cast("bigint")
    left = a.select(*keys, F.col(id).alias("a_id"), F.col(t).alias("ta"), at(F.col(t)).alias("bin"))
    right = b.select(*keys, F.col(id).alias("b_id"), F.col(t).alias("tb")).withColumn("bin", F.explode(F.sequence(at(F.col("tb") - reach), at(F.col("tb") + reach))))
    pairs = left.join(right, [*keys, "bin"]).withColumn("gap", F.abs(F.col("ta") - F.col("tb"))).where(F.col("gap") <= reach)
    of_a = pairs.groupBy(*keys, "a_id").agg(F.min(F.struct("gap", "b_id", (F.col("tb") - F.col("ta")).alias("diff"))).alias("m")).select(*keys, "a_id", "m.b_id", "m.gap", "m.diff")
    of_b = pairs.groupBy(*keys, "b_id").agg(F.min(F.struct("gap", "a_id")).alias("m")).select(*keys, "m.a_id", "b_id")
    return of_a.join(of_b, [*keys, "a_id", "b_id"])


def first_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first n rows per group; Spark keeps n per group on the map side."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def triangles(grid: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Two triangles for every full square of a grid table (keys, i, j, x, y, z), whose edges are all shorter
    than ``most``: keys, i, j, half."""
    at = lambda di, dj, n: grid.select(*keys, (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.struct("x", "y", "z").alias(n))
    q = at(0, 0, "p").join(at(1, 0, "q"), [*keys, "i", "j"]).join(at(0, 1, "r"), [*keys, "i", "j"]).join(at(1, 1, "s"), [*keys, "i", "j"])
    edge = lambda a, b: F.sqrt(sum((F.col(a)[c] - F.col(b)[c]) * (F.col(a)[c] - F.col(b)[c]) for c in "xyz"))
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.greatest(edge("p", "q"), edge("q", "s"), edge("p", "s")).alias("longest")),
        F.struct(F.lit(1).alias("half"), F.greatest(edge("p", "s"), edge("s", "r"), edge("p", "r")).alias("longest")),
    )
    return q.select(*keys, "i", "j", F.explode(halves).alias("h")).where(F.col("h.longest") < most).select(*keys, "i", "j", "h.half", "h.longest")


def padded(df: DataFrame, keys: list[str], order: str, size: int, values: list[str]) -> DataFrame:
    """keys, slot (0 … size - 1), values: the first ``size`` rows of every group, missing ones filled with zeros."""
    first = first_n(df, keys, order, size)
    w = Window.partitionBy(*keys).orderBy(order)
    rows = first.withColumn("slot", (F.row_number().over(w) - 1).cast("bigint")).select(*keys, "slot", *values)
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias("slot"))
    return grid.join(rows, [*keys, "slot"], "left").select(*keys, "slot", *[F.coalesce(F.col(v), F.lit(0).cast(df.schema[v].dataType)).alias(v) for v in values])


def plausible_circles(df: DataFrame, keys: list[str], radius: float, least: int, share: float = 0.3) -> DataFrame:
    """keys, n, cx, cy, r, err (mean radial error): circles of groups with at least ``least`` points whose radius is within
    ``share`` of ``radius`` and whose error is at most a sixth of it."""
    fits = circle_fit(df, keys).where((F.col("n") >= least) & (F.abs(F.col("r") - radius) <= share * radius))
    off = F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r"))
    error = df.select(*keys, "x", "y").join(fits.select(*keys, "cx", "cy", "r"), keys).groupBy(*keys).agg(F.avg(off).alias("err"))
    return fits.join(error, keys).where(F.col("err") <= radius / 6)


def register_grid_function(spark, name: str = "grid_cells") -> None:
    """Makes ``grid_cells(x0, x1, y0, y1, step, margin)`` a table function: the cells of a grid over an extent, upper ends excluded."""
    import math

    class Cells:
        def eval(self, x0: float, x1: float, y0: float, y1: float, step: float, margin: float):
            if None in (x0, x1, y0, y1):
                return
            for i in range(math.floor((x0 - margin) / step), math.ceil((x1 + margin) / step)):
                for j in range(math.floor((y0 - margin) / step), math.ceil((y1 + margin) / step)):
                    yield i, j

    spark.udtf.register(name, F.udtf(Cells, returnType="i bigint, j bigint"))
