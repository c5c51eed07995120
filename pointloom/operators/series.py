"""Window operators on series that may be long: exact row numbers, then windows over blocks with a halo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_US = 60_000_000


def row_index(df: DataFrame, keys: list[str], t: str, tie: str, bin_us: int = BIN_US) -> DataFrame:
    """Adds ``idx``, the place of each row in its series by (t, tie), from 0. Counts per time bin are summed up
    over bins; rows are numbered inside their bin only, so no series is sorted in one task. Rows with a null
    time are left out."""
    rows = df.where(F.col(t).isNotNull()).withColumn("_bin", F.floor(F.col(t) / F.lit(bin_us)).cast("bigint"))
    counts = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    start = counts.select(*keys, "_bin", (F.sum("_n").over(w) - F.col("_n")).alias("_start"))
    inner = Window.partitionBy(*keys, "_bin").orderBy(t, tie)
    return rows.join(start, [*keys, "_bin"]).withColumn("idx", F.col("_start") + F.row_number().over(inner) - 1).drop("_bin", "_start")


def with_halo(df: DataFrame, pos: str, block: int, before: int, after: int) -> DataFrame:
    """Adds ``blk`` and ``own``: each row in its own block and again in neighbours for which it lies within
    ``before`` ahead of their first or ``after`` behind their last position."""
    lo, hi = F.floor((F.col(pos) - after) / F.lit(block)), F.floor((F.col(pos) + before) / F.lit(block))
    return df.withColumn("blk", F.explode(F.sequence(lo, hi))).withColumn("own", F.col("blk") == F.floor(F.col(pos) / F.lit(block)))


def windowed(df: DataFrame, keys: list[str], exprs: dict, before: int, after: int, pos: str = "idx", block: int = 20_000) -> DataFrame:
    """Row windows of bounded reach over an indexed series. ``exprs``: name → function of the window spec."""
    w = Window.partitionBy(*keys, "blk").orderBy(pos)
    out = with_halo(df, pos, block, before, after)
    for name, f in exprs.items():
        out = out.withColumn(name, f(w))
    return out.where("own").drop("blk", "own")


def moving_average(v: str, w: int):
    """Zero-padded mean of w samples, as a convolution of the same length."""
    return lambda spec: F.sum(v).over(spec.rowsBetween(-(w // 2), (w - 1) // 2)) / F.lit(float(w))


def sample_period(indexed: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """keys, period (exact median of successive differences of ``t``), n (samples) of an indexed series."""
    from pointloom.operators.percentiles import exact_percentiles

    dt = windowed(indexed, keys, {"_dt": lambda w: F.col(t) - F.lag(t).over(w)}, 1, 0)
    sizes = indexed.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.join(exact_percentiles(dt.where("_dt IS NOT NULL"), keys, "_dt", {"period": 0.5}), keys, "left")


def samples(seconds: float, period_us: Column, odd: bool = False) -> Column:
    """Samples of a window of so many seconds, at least 1; with ``odd`` an even number grows by one."""
    n = F.greatest(F.lit(1), F.rint(F.lit(seconds * 1e6) / F.greatest(period_us, F.lit(1.0)))).cast("bigint")
    return F.when(n % 2 == 0, n + 1).otherwise(n) if odd else n


def smoothed(indexed: DataFrame, keys: list[str], v: str, window: str, n: str, block: int = 20_000, digits: int = 9) -> DataFrame:
    """``v`` replaced by its zero-padded moving average over ``window`` samples (a column, one value per series); a series of
    fewer samples than its window stays as it is. ``n``: column with the series' length. Blocks take half a block of their neighbours
    in, so windows go up to that."""
    names = [f for f in indexed.columns if f != v]

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        w, size = int(pdf[window].iloc[0]), int(pdf[n].iloc[0])
        x = pdf[v].to_numpy(float)
        if 1 < w <= size:
            run = np.r_[0.0, np.cumsum(x)]
            at = np.arange(len(x))
            lo, hi = np.maximum(at - w // 2, 0), np.minimum(at + (w - 1) // 2 + 1, len(x))
            pdf = pdf.assign(**{v: np.round((run[hi] - run[lo]) / w, digits)})
        return pdf.loc[pdf["own"], [*names, v]]

    types = ", ".join(f"{c} {indexed.schema[c].dataType.simpleString()}" for c in [*names, v])
    return with_halo(indexed, "idx", block, block // 2, block // 2).groupBy(*keys, "blk").applyInPandas(average, types)


def local_extremum(v: str):
    """1 at a strict local maximum, -1 at a strict local minimum, else 0."""

    def at(spec) -> Column:
        a, b = F.lag(v).over(spec), F.lead(v).over(spec)
        return F.when((F.col(v) > a) & (F.col(v) > b), 1).when((F.col(v) < a) & (F.col(v) < b), -1).otherwise(0)

    return at


def running_sum(df: DataFrame, keys: list[str], v: str, out: str, pos: str = "idx", block: int = 20_000) -> DataFrame:
    """Running sum over an indexed series: inside blocks, plus the sums of the blocks before."""
    rows = df.withColumn("blk", F.floor(F.col(pos) / F.lit(block)))
    sums = rows.groupBy(*keys, "blk").agg(F.sum(v).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("blk")
    base = sums.select(*keys, "blk", F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_base"))
    inner = Window.partitionBy(*keys, "blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(base, [*keys, "blk"]).withColumn(out, F.col("_base") + F.coalesce(F.sum(v).over(inner), F.lit(0.0))).drop("blk", "_base")


def last_seen(left: DataFrame, right: DataFrame, keys: list[str], t: str, tie: str, value: str, bin_us: int = BIN_US) -> DataFrame:
    """Each left row with the ``value`` of the last right row at or before it (null if there is none): inside
    time bins by a window, from earlier bins by the last value per bin. ``t``: bigint; ``tie`` orders rows of
    one time, right rows come first."""
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*keys, t, tie, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_bin", F.floor(F.col(t) / F.lit(bin_us)).cast("bigint"))
    per_bin = both.groupBy(*keys, "_bin").agg(F.max(F.when(F.col("_side") == 0, F.struct(t, tie, value))).alias("_l"))
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bin.select(*keys, "_bin", F.last("_l", ignorenulls=True).over(w)[value].alias("_carried"))
    inner = Window.partitionBy(*keys, "_bin").orderBy(t, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last(F.when(F.col("_side") == 0, F.col(value)), ignorenulls=True).over(inner))
    return seen.where("_side = 1").join(carried, [*keys, "_bin"]).withColumn(value, F.coalesce("_seen", "_carried")).drop("_side", "_bin", "_seen", "_carried")


def lagged_correlation(df: DataFrame, keys: list[str], a: str, b: str, most: int, pos: str = "idx") -> DataFrame:
    """keys, lag, r: sum of z(a[i + lag]) z(b[i]) / n for |lag| ≤ most, over a common index. Each row is paired
    with the 2·most + 1 rows around it by an equi-join."""
    stats = df.groupBy(*keys).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.stddev_pop(a).alias("_sa"), F.stddev_pop(b).alias("_sb"), F.count("*").alias("_n"))
    z = df.join(stats, keys)
    za = F.when(F.col("_sa") > 1e-12, (F.col(a) - F.col("_ma")) / F.col("_sa")).otherwise(F.col(a) - F.col("_ma"))
    zb = F.when(F.col("_sb") > 1e-12, (F.col(b) - F.col("_mb")) / F.col("_sb")).otherwise(F.col(b) - F.col("_mb"))
    left = z.select(*keys, F.col(pos).alias("_i"), za.alias("_a"))
    right = z.select(*keys, "_n", zb.alias("_b"), F.col(pos).alias("_j")).withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("_i", F.col("_j") + F.col("lag"))
    return left.join(right, [*keys, "_i"]).groupBy(*keys, "lag").agg((F.sum(F.col("_a") * F.col("_b")) / F.max("_n")).alias("r"))


def peak_of_correlation(corr: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lag, r, shift: lag of the largest |r| (of equal ones the smallest lag), refined by a parabola
    through its neighbours."""
    best = corr.groupBy(*keys).agg(F.min(F.struct((-F.abs("r")).alias("a"), F.col("lag"), F.col("r"))).alias("m")).select(*keys, "m.lag", "m.r")
    side = lambda d, n: corr.select(*keys, (F.col("lag") - d).alias("lag"), F.abs("r").alias(n))
    j = best.join(side(-1, "c0"), [*keys, "lag"], "left").join(side(1, "c2"), [*keys, "lag"], "left")
    denom = F.col("c0") - 2 * F.abs("r") + F.col("c2")
    shift = F.when(F.abs(denom) > 1e-12, 0.5 * (F.col("c0") - F.col("c2")) / F.when(F.abs(denom) > 1e-12, denom)).otherwise(0.0)
    return j.select(*keys, "lag", "r", (F.col("lag") + F.coalesce(shift, F.lit(0.0))).alias("shift"))


def integral(indexed: DataFrame, keys: list[str], v: str, out: str, t: str = "t", times: int = 1) -> DataFrame:
    """Trapezoid integral over ``t`` (µs) from the start of each series, once or repeatedly."""
    for n in range(times):
        x, last = (v if n == 0 else f"_i{n - 1}"), (out if n == times - 1 else f"_i{n}")
        step = lambda w, x=x: F.coalesce((F.col(x) + F.lag(x).over(w)) / 2 * (F.col(t) - F.lag(t).over(w)) / 1e6, F.lit(0.0))
        indexed = running_sum(windowed(indexed, keys, {"_a": step}, 1, 0), keys, "_a", last).drop("_a")
    return indexed


def savgol(v: str, window: int, derivative: int):
    """Derivative (1 or 2, per sample) of the parabola fitted to an odd window; null where the window leaves the series."""
    h = window // 2
    s0, s2, s4 = (float(sum(j**k for j in range(-h, h + 1))) for k in (0, 2, 4))
    weight = lambda j: j / s2 if derivative == 1 else 2 * (s0 * j * j - s2) / (s0 * s4 - s2 * s2)
    return lambda spec: sum(F.lit(weight(j)) * F.lead(v, j).over(spec) for j in range(-h, h + 1))


def on_common_clock(readings: DataFrame, keys: list[str], sensor: str, t: str, moved: str, anchor: str) -> DataFrame:
    """``readings`` with ``t`` of sensor ``moved`` shifted so that its first stamp meets that of ``anchor`` (not at all where one of
    them has none), and ``rel``: time from the earliest stamp of all sensors."""
    first = readings.groupBy(*keys).agg(*[F.min(F.when(F.col(sensor) == s, F.col(t))).alias(n) for s, n in ((moved, "_m"), (anchor, "_a"))])
    shift = F.when(F.col(sensor) == moved, F.coalesce(F.col("_m") - F.col("_a"), F.lit(0))).otherwise(F.lit(0))
    out = readings.join(first, keys).withColumn(t, F.col(t) - shift).drop("_m", "_a")
    return out.join(out.groupBy(*keys).agg(F.min(t).alias("_z")), keys).withColumn("rel", F.col(t) - F.col("_z")).drop("_z")
