"""Model fits: planes by RANSAC, rigid transforms, registration, hulls and peaks.

Everything that is counted or summed runs over all points; planes are counted by numpy in chunks or bounded groups,
other solvers get one small row per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.session import materialize

TRIPLES, CHUNK, WHOLE = 2000, 50_000, 200_000
MISSED = 1e-8


def _models(p: np.ndarray) -> np.ndarray:
    """Unit normal and offset of the plane through each triple of points (n × 3 × 3); a triple in line gives NaN."""
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    size = np.linalg.norm(n, axis=1)
    n = n / np.where(size > 1e-9, size, np.nan)[:, None]
    return np.c_[n, -(n * p[:, 0]).sum(axis=1)]


def _votes(x: np.ndarray, models: np.ndarray, thresh: float) -> np.ndarray:
    """Points of ``x`` nearer than ``thresh`` to each model."""
    out, m, step = np.zeros(len(models), np.int64), np.ascontiguousarray(models.T), 255  # a byte counts so many
    x = np.c_[x, np.ones(len(x))]
    far, near = np.empty((step, len(models))), np.empty((step, len(models)), bool)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        f, k = far[: len(part)], near[: len(part)]
        np.matmul(part, m, out=f)
        np.abs(f, out=f)
        np.less(f, thresh, out=k)
        out += np.add.reduce(k.view(np.uint8), axis=0, dtype=np.uint8)
    return out


def _draw(rng: np.random.Generator, n: int, triples: int) -> np.ndarray:
    """Rows of ``triples`` triples; a row drawn twice in one makes it a triple in line."""
    return rng.integers(0, n, (triples, 3))


def best_plane(x: np.ndarray, thresh: float, rng: np.random.Generator, triples: int = TRIPLES, batch: int = 200) -> tuple[np.ndarray, int]:
    """Model with most inliers and their number. Triples come from all points, every model is counted over all
    points; drawing ends at ``triples``, or once a plane as large as the best was missed with probability ``MISSED``."""
    best, most, drawn = np.zeros(4), 0, 0
    while drawn < triples and len(x) > 2:
        models = _models(x[_draw(rng, len(x), min(batch, triples - drawn))])
        votes = _votes(x, models, thresh)
        k = int(votes.argmax())
        if votes[k] > most:
            best, most = models[k], int(votes[k])
        drawn += len(models)
        if drawn * np.log1p(-min((most / len(x)) ** 3, 1 - 1e-12)) <= np.log(MISSED):
            break
    return best, most


def _peeled(keys: list[str], thresh: float, most: int | None, least: int, seed: int, triples: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["x", "y", "z"]].to_numpy(float)[np.argsort(pdf["id"].to_numpy(), kind="stable")]
        head, turn = [pdf[k].iloc[0] for k in keys], int(pdf["done"].iloc[0])
        rng, rows = np.random.default_rng(seed), []
        while len(x) >= max(least, 3) and (most is None or turn < most):
            plane, n = best_plane(x, thresh, rng, triples)
            if n < least:
                break
            near = np.abs(x @ plane[:3] + plane[3]) < thresh
            c = x[near] - x[near].mean(axis=0)
            v = np.linalg.eigh(c.T @ c)[1][:, 0]
            v = -v if v @ plane[:3] < 0 else v
            d = float(-v @ x[near].mean(axis=0))
            rows.append([*head, *map(float, v), d, int(near.sum()), turn])
            gone = np.abs(x @ v + d) < thresh
            x, turn = x[~(gone if gone.any() else near)], turn + 1
        return pd.DataFrame(rows, columns=[*keys, "a", "b", "c", "d", "inliers", "turn"])

    return solve


def _hypotheses(keys: list[str], seed: int, triples: int):
    def propose(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["x", "y", "z"]].to_numpy(float)[np.lexsort((pdf["id"].to_numpy(), pdf["_r"].to_numpy()))]
        whole = len(x) == 3 * triples
        m = _models(x.reshape(-1, 3, 3) if whole else x[_draw(np.random.default_rng(seed), len(x), triples)])
        row = [*[pdf[k].iloc[0] for k in keys], m.ravel()]
        return pd.DataFrame([row], columns=[*keys, "models"])

    return propose


def _counted(keys: list[str], thresh: float):
    def count(pts: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if pts.empty or models.empty:
            return pd.DataFrame(columns=[*keys, "k", "n"])
        m = np.array(models["models"].iloc[0], float).reshape(-1, 4)
        out = pd.DataFrame({"k": np.arange(len(m), dtype=np.int32), "n": _votes(pts[["x", "y", "z"]].to_numpy(float), m, thresh)})
        for i, k in enumerate(keys):
            out.insert(i, k, pts[k].iloc[0])
        return out[out["n"] > 0]

    return count


def _refit(keys: list[str]):
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                n = r["n"]
                m = np.array([r["sx"], r["sy"], r["sz"]]) / n
                c = np.array([[r["sxx"], r["sxy"], r["sxz"]], [r["sxy"], r["syy"], r["syz"]], [r["sxz"], r["syz"], r["szz"]]]) / n - np.outer(m, m)
                v = np.linalg.eigh(c)[1][:, 0]
                if v @ np.array([r["a"], r["b"], r["c"]]) < 0:
                    v = -v
                rows.append([*[r[k] for k in keys], float(v[0]), float(v[1]), float(v[2]), float(-v @ m), int(n)])
            yield pd.DataFrame(rows, columns=[*keys, "a", "b", "c", "d", "inliers"])

    return solve


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def ransac_planes(df: DataFrame, keys: list[str], id: str, thresh: float, seed: int = 0, least: int = 3, triples: int = TRIPLES) -> DataFrame:
    """keys, a, b, c, d, inliers: one plane per group (unit normal). ``triples`` triples are drawn from all points
    of the group (a large group's are its points of smallest hashed id, three by three) and every one is counted over all points, in
    chunks; the winner (most inliers, then the earlier) is refitted to all its inliers by moments. Groups with
    fewer than ``least`` inliers give no row."""
    pts = df.select(*keys, F.col(id).alias("id"), "x", "y", "z")
    w = Window.partitionBy(*keys).orderBy(F.xxhash64("id", F.lit(seed)), "id")
    sample = pts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3 * triples)
    models = sample.groupBy(*keys).applyInPandas(_hypotheses(keys, seed, triples), _ddl(df, keys) + "models array<double>")
    parts = pts.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("_parts"))
    models = materialize(models.join(parts, keys), "models")
    chunked = pts.join(models.select(*keys, "_parts"), keys).withColumn("_c", F.pmod(F.xxhash64("id", F.lit(seed + 1)), "_parts")).drop("_parts", "id")
    each = models.select(*keys, "models", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_c"))
    votes = chunked.groupBy(*keys, "_c").cogroup(each.groupBy(*keys, "_c")).applyInPandas(_counted(keys, thresh), _ddl(df, keys) + "k int, n bigint")
    votes = votes.groupBy(*keys, "k").agg(F.sum("n").alias("n"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "k")).alias("b")).select(*keys, F.col("b.k").alias("k"))
    chosen = models.join(best, keys).select(*keys, *[F.expr(f"models[4 * k + {i}]").alias(c) for i, c in enumerate("abcd")])
    inl = pts.join(chosen, keys).where(F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")) < thresh)
    sums = [F.sum(F.col(p)).alias(f"s{p}") for p in "xyz"] + [F.sum(F.col(p) * F.col(q)).alias(f"s{p}{q}") for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")]
    m = inl.groupBy(*keys, "a", "b", "c", "d").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    return m.mapInPandas(_refit(keys), _ddl(df, keys) + "a double, b double, c double, d double, inliers bigint")


def peel_planes(df: DataFrame, keys: list[str], id: str, thresh: float, most: int | None = None, least: int = 200, seed: int = 0, triples: int = TRIPLES, whole: int = WHOLE) -> DataFrame:
    """keys, plane (by inliers, most first), a, b, c, d, inliers: planes found one after the other, each without
    the inliers of those before; ends where none has ``least`` inliers, or at ``most``. Groups of more than ``whole``
    points lose a plane a turn by joins; what is left of any group, once it is that small, is peeled in one task."""
    rest, found, turn = df.select(*keys, F.col(id).alias("id"), "x", "y", "z"), None, 0
    while most is None or turn < most:
        big = materialize(rest.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > whole).drop("_n"), "big")
        if big.isEmpty():
            break
        one = materialize(ransac_planes(rest.join(big, keys, "left_semi"), keys, "id", thresh, seed + turn, least, triples), "plane").withColumn("turn", F.lit(turn))
        found = one if found is None else found.unionByName(one)
        near = F.coalesce(F.abs(F.col("_p.a") * F.col("x") + F.col("_p.b") * F.col("y") + F.col("_p.c") * F.col("z") + F.col("_p.d")) < thresh, F.lit(False))
        ended = big.join(one, keys, "left_anti")
        rest = rest.join(ended, keys, "left_anti").join(one.select(*keys, F.struct("a", "b", "c", "d").alias("_p")), keys, "left")
        rest, turn = materialize(rest.where(~near).drop("_p"), "rest"), turn + 1
    done = F.lit(0)
    if found is not None:
        rest, done = rest.join(found.groupBy(*keys).agg(F.count("*").alias("_k")), keys, "left"), F.coalesce("_k", F.lit(0))
    few = rest.select(*keys, "id", "x", "y", "z", done.cast("int").alias("done"))
    last = few.groupBy(*keys).applyInPandas(_peeled(keys, thresh, most, least, seed, triples), _ddl(df, keys) + "a double, b double, c double, d double, inliers bigint, turn int")
    w = Window.partitionBy(*keys).orderBy(F.desc("inliers"), "turn")
    return (last if found is None else found.unionByName(last)).withColumn("plane", F.row_number().over(w).cast("bigint") - 1).drop("turn")


def kabsch(m: np.ndarray, n: int, ma: np.ndarray, mb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation taking a onto b, from the cross sums ``m`` = Σ a bᵀ, the count and the means."""
    u, _, vt = np.linalg.svd(m - n * np.outer(ma, mb))
    s = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ s @ u.T
    return r, mb - r @ ma


def rigid_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs``: keys, ax…az, bx…bz. Out: keys, n, r (9 numbers by rows), t (3), rms of R a + t − b."""
    a, b = ["ax", "ay", "az"], ["bx", "by", "bz"]
    agg = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in (*a, *b)], *[F.sum(F.col(p) * F.col(q)).alias(f"s{p}{q}") for p in a for q in b]]
    agg += [F.sum(sum(F.col(c) * F.col(c) for c in a)).alias("saa"), F.sum(sum(F.col(c) * F.col(c) for c in b)).alias("sbb")]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x in pdf.to_dict("records"):
                ma, mb = (np.array([x[f"m{c}"] for c in s]) for s in (a, b))
                m = np.array([[x[f"s{p}{q}"] for q in b] for p in a])
                r, t = kabsch(m, x["n"], ma, mb)
                n = x["n"]
                sq = x["saa"] + x["sbb"] + n * t @ t - 2 * np.trace(r @ m) + 2 * n * t @ (r @ ma) - 2 * n * t @ mb
                rows.append([*[x[k] for k in keys], n, r.ravel().tolist(), t.tolist(), float(np.sqrt(max(sq, 0) / n))])
            yield pd.DataFrame(rows, columns=[*keys, "n", "r", "t", "rms"])

    return pairs.groupBy(*keys).agg(*agg).mapInPandas(solve, _ddl(pairs, keys) + "n bigint, r array<double>, t array<double>, rms double")


def closest_points(a: DataFrame, b: DataFrame, reach: float, keys: list[str] | None = None) -> DataFrame:
    """For each point of ``a`` (keys, id, x, y, z) the nearest of ``b`` with equal keys within ``reach``: id, ax…az, bx…bz, d2. Points
    meet in grid cells as wide as the reach; of equal distances the smaller id of b."""
    keys = keys or []
    c = lambda v: F.floor(F.col(v) / F.lit(float(reach))).cast("bigint")
    left = a.select(*keys, "id", *[F.col(v).alias(f"a{v}") for v in "xyz"], *[c(v).alias(f"c{v}") for v in "xyz"])
    right = b.select(*keys, F.col("id").alias("bid"), *[F.col(v).alias(f"b{v}") for v in "xyz"], *[c(v).alias(f"c{v}") for v in "xyz"])
    for v in ("cx", "cy", "cz"):
        right = right.withColumn(v, F.explode(F.array(F.col(v) - 1, F.col(v), F.col(v) + 1)))
    d2 = sum((F.col(f"a{v}") - F.col(f"b{v}")) * (F.col(f"a{v}") - F.col(f"b{v}")) for v in "xyz")
    near = left.join(right, [*keys, "cx", "cy", "cz"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    best = near.groupBy(*keys, "id", "ax", "ay", "az").agg(F.min(F.struct("d2", "bid", "bx", "by", "bz")).alias("m"))
    return best.select(*keys, "id", "ax", "ay", "az", "m.bx", "m.by", "m.bz", "m.d2")


def icp(a: DataFrame, b: DataFrame, reaches: tuple[float, ...] = (1.0, 0.5, 0.25), rounds: int = 10, tol: float = 1e-6) -> tuple[np.ndarray, float, float]:
    """4×4 transform taking cloud ``a`` onto ``b`` (id, x, y, z each), share of matched points and their rms.
    Each round is one join and one aggregate; only its sums reach the driver. From coarse to fine reaches."""
    total = np.eye(4)
    count, fit, rms = a.count(), 0.0, 0.0
    for reach in reaches:
        last = None
        for _ in range(rounds):
            moved = a.select("id", *[sum(float(total[i, j]) * F.col(v) for j, v in enumerate("xyz")) + float(total[i, 3]) for i in range(3)]).toDF("id", "x", "y", "z")
            row = rigid_fit(closest_points(moved, b, reach).withColumn("g", F.lit(0)), ["g"]).first()
            if row is None or row["n"] < 3:
                break
            step = np.eye(4)
            step[:3, :3], step[:3, 3] = np.array(row["r"]).reshape(3, 3), row["t"]
            total, fit, rms = step @ total, row["n"] / count, row["rms"]
            if last is not None and abs(last - rms) <= tol * max(last, 1e-12):
                break
            last = rms
    return total, fit, rms


def hull(x: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of 2-D points, counter-clockwise (monotone chain)."""
    p = np.unique(x, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def convex_hulls(df: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """keys, k, x, y: hull corners per group. Hulls of hashed parts first, then the hull of their corners, so a
    large group is never gathered."""
    schema = _ddl(df, keys) + "k int, x double, y double"

    def corner_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy(float))
        out = pd.DataFrame({"k": np.arange(len(h), dtype=np.int32), "x": h[:, 0], "y": h[:, 1]})
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    salted = df.select(*keys, "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(parts)).alias("_p"))
    return salted.groupBy(*keys, "_p").applyInPandas(corner_rows, schema).groupBy(*keys).applyInPandas(corner_rows, schema)


def _low_before_higher(h: np.ndarray) -> np.ndarray:
    """For each place the lowest value from the last higher one (or the start) up to it."""
    out, stack = h.copy(), []  # stack: places of falling height, each with the lowest value since the one before
    for i, x in enumerate(h.tolist()):
        low = x
        while stack and stack[-1][0] <= x:
            low = min(low, stack.pop()[1])
        out[i] = low
        stack.append((x, low))
    return out


def peaks(v: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Positions of maxima (middle of plateaus) at least ``distance`` apart, the higher first (of equal ones the earlier), with
    at least ``prominence`` over the higher of the two lowest points between them and higher ground."""
    if len(v) < 3:
        return np.zeros(0, int)
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    h, middle = v[first], (first + np.r_[first[1:], len(v)] - 1) // 2
    top = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])) + 1
    at, keep = middle[top], np.ones(len(top), bool)
    for k in np.argsort(-h[top], kind="stable").tolist():
        if keep[k]:
            lo, hi = np.searchsorted(at, [at[k] - distance + 1, at[k] + distance])
            keep[lo:k] = keep[k + 1 : hi] = False
    base = np.maximum(_low_before_higher(h), _low_before_higher(h[::-1])[::-1])[top]
    return at[keep & (h[top] - base >= prominence)]


def series_peaks(indexed: DataFrame, keys: list[str], id: str, distance: int | str, prominence: float | str, block: int = 20_000, both: bool = False) -> DataFrame:
    """keys, id, kind (1 maximum; -1 minimum, only with ``both``) of peaks of an indexed series (``idx``, ``v``). ``distance``
    and ``prominence`` may name columns that hold one value per series. Series are worked on in blocks with half a block
    on either side: what decides a peak is looked for so far."""
    from pointloom.operators.series import with_halo

    column = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v, far, high = pdf["v"].to_numpy(float), int(pdf["_far"].iloc[0]), float(pdf["_high"].iloc[0])
        parts = [pdf.iloc[peaks(s * v, far, high)].assign(kind=np.int32(s)) for s in ((1, -1) if both else (1,))]
        return pd.concat(parts).loc[lambda p: p["own"], [*keys, id, "kind"]]

    rows = with_halo(indexed.select(*keys, id, "idx", "v", column(distance).alias("_far"), column(prominence).alias("_high")), "idx", block, block // 2, block // 2)
    return rows.groupBy(*keys, "blk").applyInPandas(find, _ddl(indexed, keys) + f"{id} {indexed.schema[id].dataType.simpleString()}, kind int")
