"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.session import materialize, release


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has a parent itself."""
    parents = edges.select(F.col("b").alias("a"), F.lit(0).alias("k"))
    seen = edges.select("a", F.lit(1).alias("k")).unionByName(parents.distinct())
    mixed = seen.groupBy("a").agg(F.sum("k").alias("up"), F.min("k").alias("root")).where("up > 1 OR (up = 1 AND root = 0)")
    return mixed.isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge to another one.

    Null ends and loops are ignored, repeated edges count once; no edges give no rows. Every round halves
    path lengths, hubs are handled by joining each edge with its end's smallest neighbour (an aggregate that
    is combined before the shuffle; skewed keys of the join are split by adaptive execution). Each round
    ends in a written table.
    """
    e = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if _stars(e):
            break
        # large star: the larger neighbours of each node are tied to its smallest neighbour (or itself)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours and the node itself are tied to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        last, e = e, materialize(small, "edges")
        release(last)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).distinct()
