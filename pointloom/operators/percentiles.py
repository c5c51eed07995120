"""Exact percentiles per group in two counting passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import finite


def _bin(v: Column) -> Column:
    """A number that never decreases with v, some hundred per decade."""
    return F.floor(F.asinh(v * 1e6) * 64)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """keys and one column per name in ``probs``: linear interpolation between order statistics.

    Null, NaN and infinite values don't count; a group without values gives no row. First the rows are
    counted by bins, then only the distinct values in the bins that hold the wanted ranks; both counts are
    combined before the shuffle, so no group is gathered however large it is.
    """
    rows = df.where(finite(value)).select(*keys, F.col(value).cast("double").alias("v")).withColumn("bin", _bin(F.col("v")))
    hist = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("bin")
    placed = hist.withColumn("below", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    ranks = []
    for name, p in probs.items():
        at = (F.col("total") - 1) * F.lit(p)
        ranks += [F.struct(F.lit(name).alias("name"), F.floor(at).alias("rank"), (1 - (at - F.floor(at))).alias("share")), F.struct(F.lit(name).alias("name"), F.ceil(at).alias("rank"), (at - F.floor(at)).alias("share"))]
    wanted = placed.withColumn("r", F.explode(F.array(*ranks))).where((F.col("r.rank") >= F.col("below")) & (F.col("r.rank") < F.col("below") + F.col("n")))
    wanted = wanted.select(*keys, "bin", (F.col("r.rank") - F.col("below")).alias("rank"), "r.name", "r.share")
    inside = rows.join(wanted.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi").groupBy(*keys, "bin", "v").agg(F.count("*").alias("m"))
    wv = Window.partitionBy(*keys, "bin").orderBy("v")
    values = inside.withColumn("before", F.sum("m").over(wv) - F.col("m"))
    hit = values.join(wanted, [*keys, "bin"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
    return hit.groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == n, F.col("v") * F.col("share"))).alias(n) for n in probs])
