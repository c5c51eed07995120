"""Small calibration steps: candidate subsets against a known pattern, correspondences, residuals by pose.

Candidates are a handful of rows per pose, so joins inside a pose are small; poses are spread over tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CANDIDATES = 40
MOST_ORDERED = 6


def pattern_distances(points: Sequence[Sequence[float]]) -> list[float]:
    """The sorted pairwise distances of a pattern."""
    return sorted(float(np.linalg.norm(np.subtract(a, b))) for a, b in itertools.combinations(points, 2))


def find_pattern(candidates: DataFrame, pose: str, id: str, pattern: Sequence[Sequence[float]], tol: float = 0.15) -> DataFrame:
    """pose, ids (4, ascending), mismatch: of each pose's candidates (x, y) the four whose sorted pairwise distances
    differ least, at most ``tol``, from those of ``pattern``; of equal ones the first by ids. Poses with more
    than ``MOST_CANDIDATES`` candidates are an error (they would have over 90 000 subsets)."""
    few = candidates.groupBy(pose).agg(F.count("*").alias("n"))
    checked = candidates.join(few, pose).withColumn("x", F.when(F.col("n") <= MOST_CANDIDATES, F.col("x")).otherwise(F.raise_error(F.lit("too many candidates"))))
    side = lambda k: checked.select(pose, F.col(id).alias(f"i{k}"), F.struct("x", "y").alias(f"p{k}"))
    four = side(0)
    for k in range(1, 4):
        four = four.join(side(k), pose).where(F.col(f"i{k}") > F.col(f"i{k - 1}"))
    gap = lambda a, b: F.hypot(F.col(f"p{a}.x") - F.col(f"p{b}.x"), F.col(f"p{a}.y") - F.col(f"p{b}.y"))
    got = F.array_sort(F.array(*[gap(a, b) for a, b in itertools.combinations(range(4), 2)]))
    want = F.array(*[F.lit(v) for v in pattern_distances(pattern)])
    worst = F.array_max(F.zip_with(got, want, lambda a, b: F.abs(a - b)))
    best = four.withColumn("mismatch", worst).where(F.col("mismatch") <= tol).groupBy(pose).agg(F.min(F.struct("mismatch", F.array("i0", "i1", "i2", "i3").alias("ids"))).alias("m"))
    return best.select(pose, "m.ids", "m.mismatch")


def _best_order(a: np.ndarray, target: np.ndarray) -> tuple[int, ...]:
    """For each row of ``a`` its row of ``target``: the order with the least residual of a rigid fit."""
    from pointloom.operators.fit import kabsch

    best: tuple[float, tuple[int, ...]] | None = None
    for p in itertools.permutations(range(len(target))):
        b = target[list(p)]
        r, t = kabsch(a.T @ b, len(a), a.mean(axis=0), b.mean(axis=0))
        res = float((((a @ r.T + t) - b) ** 2).sum())
        if best is None or res < best[0] - 1e-12:
            best = (res, p)
    return best[1]


def _paired(pdf: pd.DataFrame, target: np.ndarray, pose: str, order: str) -> pd.DataFrame:
    names = [pose, order, "place", "ax", "ay", "az", "bx", "by", "bz"]
    pdf = pdf.sort_values(order)
    a = pdf[["x", "y", "z"]].to_numpy(float)
    if not len(a) or len(a) != len(target) or len(a) > MOST_ORDERED:
        return pd.DataFrame(columns=names)
    place = _best_order(a, target)
    b = target[list(place)]
    return pd.DataFrame(dict(zip(names, (pdf[pose].to_numpy(), pdf[order].to_numpy(), np.array(place, np.int32), *a.T, *b.T), strict=True)))


def _pair_schema(points: DataFrame, pose: str, order: str) -> str:
    kinds = [f"{c} {points.schema[c].dataType.simpleString()}" for c in (pose, order)]
    return ", ".join([*kinds, "place int", *[f"{s}{c} double" for s in "ab" for c in "xyz"]])


def correspond(points: DataFrame, pose: str, order: str, pattern: Sequence[Sequence[float]]) -> DataFrame:
    """pose, order, place, ax…az, and bx, by, bz of the pattern point each of a pose's points belongs to. Poses with
    another number of points than the pattern (at most ``MOST_ORDERED``) are left out."""
    target = np.array(pattern, float)
    return points.groupBy(pose).applyInPandas(lambda pdf: _paired(pdf, target, pose, order), _pair_schema(points, pose, order))


def correspond_targets(points: DataFrame, targets: DataFrame, pose: str, order: str) -> DataFrame:
    """As ``correspond``, with targets of their own for each pose (``targets``: pose, order, x, y, z); ``place``
    counts a pose's targets by their order."""
    targets = targets.toDF(*targets.columns)  # may stem from the same table
    choose = lambda a, b: _paired(a, b.sort_values(order)[["x", "y", "z"]].to_numpy(float), pose, order)
    return points.groupBy(pose).cogroup(targets.groupBy(pose)).applyInPandas(choose, _pair_schema(points, pose, order))


def pose_residuals(pairs: DataFrame, pose: str, r: Sequence[float], t: Sequence[float]) -> DataFrame:
    """pose, n, rms of R a + t − b, worst first."""
    b = [F.col(f"b{c}") for c in "xyz"]
    a = [F.col(f"a{c}") for c in "xyz"]
    moved = [sum(float(r[3 * i + j]) * a[j] for j in range(3)) + float(t[i]) for i in range(3)]
    sq = sum((m - q) * (m - q) for m, q in zip(moved, b, strict=True))
    return pairs.groupBy(pose).agg(F.count("*").alias("n"), F.sqrt(F.avg(sq)).alias("rms")).orderBy(F.desc("rms"), pose)


def undistorted(u: F.Column, v: F.Column, fx: float, fy: float, cx: float, cy: float, k: Sequence[float], rounds: int = 8) -> tuple[F.Column, F.Column]:
    """Ideal pinhole coordinates (x/z, y/z) of a fisheye pixel: the angle by a fixed number of Newton steps."""
    x, y = (u - cx) / fx, (v - cy) / fy
    d = F.sqrt(x * x + y * y)

    def step(th: F.Column, _: F.Column) -> F.Column:
        t2 = th * th
        f = th * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3])))) - d
        return th - f / (1 + t2 * (3 * k[0] + t2 * (5 * k[1] + t2 * (7 * k[2] + t2 * 9 * k[3]))))

    # a fold, as nested columns would grow with every step
    th = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), d, step)
    scale = F.when(d > 1e-12, F.tan(th) / F.greatest(d, F.lit(1e-12))).otherwise(1.0)
    return x * scale, y * scale
