"""Time offset of two sensors of one motion by cross-correlation, on a common grid that is cut into blocks.

``a`` is a position (distance), ``b`` an acceleration. Both are brought to velocity, acceleration and position,
normalised over the whole series and correlated over all lags up to ``most_s`` seconds. Integrals and trends run
through the whole series: a block adds its own integral, and one small row per block carries level and line on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.fit import series_peaks
from pointloom.operators.percentiles import exact_percentiles
from pointloom.operators.series import peak_of_correlation, row_index, sample_period, samples, smoothed
from pointloom.operators.spatial import mutual_nearest
from pointloom.session import materialize

ORDERS = ("velocity", "accel", "position")
BLOCK = 12_000
SMOOTH_S = 0.4
LEAST = 16
COLUMNS = ["blk", "n", "k0", "m", "d", "acc", "before", "sd", "sjd", "sv", "sjv", "ev", "sx", "sjx", "ex"]


def _odd(n: int) -> int:
    return n if n % 2 else n + 1


def smoothing_window(n: int, dt: float) -> int:
    """Samples of the smoothed derivative's window on a grid of ``n``."""
    return _odd(max(5, min(n // 2, int(SMOOTH_S / dt + 1e-9))))


def smoothed_derivative(x: np.ndarray, win: int, order: int, dt: float, first: bool, last: bool) -> np.ndarray:
    """Savitzky–Golay derivative (second degree). Where the series begins or ends, its outer half window follows
    the parabola fitted to its outermost window; elsewhere half a window at either end is not defined."""
    h = win // 2
    j = np.arange(-h, h + 1, dtype=float)
    fit = np.linalg.pinv(np.vander(j, 3, increasing=True))
    out = np.full(len(x), np.nan)
    out[h : len(x) - h] = np.correlate(x, fit[order], "valid") * order / dt**order
    for at_end, c, part in ((first, fit @ x[:win], slice(0, h)), (last, fit @ x[-win:], slice(len(x) - h, len(x)))):
        if at_end:
            p = j[:h] if part.start == 0 else j[-h:]
            out[part] = (c[1] + 2 * c[2] * p) / dt if order == 1 else 2 * c[2] / dt**2
    return out


def _running(x: np.ndarray, before: float | None, dt: float) -> np.ndarray:
    """Trapezoid integral up to each sample, from the sample ``before`` (or the first one, if None)."""
    y = np.concatenate([[x[0] if before is None else before], x])
    step = (y[1:] + y[:-1]) * (dt / 2)
    return np.cumsum(step if before is not None else np.concatenate([[0.0], step[1:]]))


def _power_sums(n: int) -> tuple[float, float, float, float]:
    n = float(n)
    return n, n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6, (n * (n - 1) / 2) ** 2


def _line(n: int, sums: np.ndarray) -> tuple[float, float]:
    """Intercept at sample 0 and slope of the line through a grid of ``n`` samples with Σ y and Σ (k − mid) y."""
    slope = sums[1] / (n * (n * n - 1) / 12)
    return sums[0] / n - slope * (n - 1) / 2, slope


def _carry(keys: list[str], dt: float):
    """Per series, one row a block in: level, trend and start of both integrals of each block out."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        n = int(pdf["n"].iloc[0])
        mid = (n - 1) / 2
        rows = pdf.to_dict("records")
        d0, d1 = _line(n, np.sum([[r["sd"], (r["k0"] - mid) * r["sd"] + r["sjd"]] for r in rows], axis=0))
        v, sums, starts = 0.0, np.zeros(2), []
        for r in rows:
            starts.append(v)
            s0, s1, *_ = _power_sums(r["m"])
            total, first = r["sv"] + v * s0, r["sjv"] + v * s1
            sums += [total, (r["k0"] - mid) * total + first]
            v += r["ev"]
        v0, v1 = _line(n, sums)
        x, sums, out = 0.0, np.zeros(2), []
        for r, level in zip(rows, starts, strict=True):
            s = 0 if r["k0"] == 0 else -1
            e0, e1 = level - v0 - v1 * r["k0"], -v1
            q = np.array([x - dt * (e0 * s + e1 * s * s / 2), dt * e0, dt * e1 / 2])
            p = _power_sums(r["m"])
            total, first = r["sx"] + q @ p[:3], r["sjx"] + q @ p[1:]
            sums += [total, (r["k0"] - mid) * total + first]
            j = r["m"] - 1
            x = r["ex"] + q @ [1.0, j, j * j]
            out.append([e0, e1, q])
        x0, x1 = _line(n, sums)
        done = [[*[r[k] for k in keys], r["blk"], d0, d1, e0, e1, q[0] - x0 - x1 * r["k0"], q[1] - x1, q[2]] for r, (e0, e1, q) in zip(rows, out, strict=True)]
        return pd.DataFrame(done, columns=[*keys, "blk", "d0", "d1", "v0", "v1", "x0", "x1", "x2"])

    return solve


def _segments(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Each reading with the next one of its series (itself at the end) and the number of its series' readings; of equal
    times the largest id counts, so repeated rows count once."""
    rows = df.withColumn("_bin", F.floor(F.col("t") / F.lit(width)).cast("bigint")).repartition(*keys, "_bin")
    at = rows.groupBy(*keys, "_bin", "t").agg(F.max(F.struct("id", "v"))["v"].alias("v"))
    firsts = at.groupBy(*keys, "_bin").agg(F.min(F.struct("t", "v")).alias("_f"), F.count("*").alias("_c"))
    after = firsts.select(*keys, "_bin", F.lead("_f").over(Window.partitionBy(*keys).orderBy("_bin")).alias("_after"), F.sum("_c").over(Window.partitionBy(*keys)).alias("readings"))
    inner = F.lead(F.struct("t", "v")).over(Window.partitionBy(*keys, "_bin").orderBy("t"))
    seg = at.withColumn("_next", inner).join(after, [*keys, "_bin"]).withColumn("_next", F.coalesce("_next", "_after", F.struct("t", "v")))
    return seg.select(*keys, "t", "v", F.col("_next.t").alias("t1"), F.col("_next.v").alias("v1"), "readings")


def lag_correlations(a: DataFrame, b: DataFrame, keys: list[str], hz: int = 200, most_s: float = 1.0, block: int = BLOCK) -> DataFrame:
    """keys, method, lag, r: Σ z(a[k + lag]) z(b[k]) / n on the grid of ``hz`` over the time both series run, for
    every |lag| ≤ most_s · hz and each of ``ORDERS``. ``a``, ``b``: keys, t (µs), id, v; rows may repeat. Series with fewer than 5
    readings or 16 common samples give no row."""
    step, dt, most = 1_000_000 // hz, 1.0 / hz, int(most_s * hz + 1e-9)
    halo = most + smoothing_window(10**9, dt) + 1
    ends = lambda df, p: df.groupBy(*keys).agg(F.min("t").alias(f"{p}0"), F.max("t").alias(f"{p}1"), F.avg("v").alias(f"{p}m"))
    both = ends(a, "a").join(ends(b, "b"), keys)
    n = F.ceil((F.least("a1", "b1") - F.greatest("a0", "b0")) / F.lit(step)).cast("bigint")
    span = materialize(both.select(*keys, F.greatest("a0", "b0").alias("g0"), n.alias("n"), F.col("bm").alias("mean")).where(F.col("n") >= LEAST), "span")
    sides = _segments(a, keys, block * step).withColumn("side", F.lit(0)).unionByName(_segments(b, keys, block * step).withColumn("side", F.lit(1)))
    blk = lambda t: F.floor((F.col(t) - F.col("g0")) / F.lit(block * step))
    near = sides.where("readings >= 5").withColumn("_lo", F.col("t") - halo * step).withColumn("_hi", F.col("t1") + halo * step).join(span, keys)
    last = F.floor((F.col("n") - 1) / F.lit(block))
    lo, hi = F.greatest(F.lit(0), blk("_lo")), F.least(last, blk("_hi"))
    placed = near.where(lo <= hi).withColumn("blk", F.explode(F.sequence(lo, hi))).select(*keys, "blk", "side", "t", "v", "t1", "v1", "g0", "n", "mean")
    types = "".join(f"{k} {a.schema[k].dataType.simpleString()}, " for k in keys)

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        head, g0, n, at = [pdf[k].iloc[0] for k in keys], int(pdf["g0"].iloc[0]), int(pdf["n"].iloc[0]), int(pdf["blk"].iloc[0])
        k0, k1 = at * block, min(n, (at + 1) * block)
        if pdf["side"].nunique() < 2:  # the other series has too few readings
            return pd.DataFrame(columns=[*keys, *COLUMNS])
        left, right = max(0, k0 - halo), min(n, k1 + halo)
        series = []
        for side, (lo, hi) in enumerate(((left, right), (max(0, k0 - 1), k1))):
            p = pdf[pdf["side"] == side]
            t, u = np.unique(np.concatenate([p["t"], p["t1"]]) - g0, return_index=True)
            series.append(np.interp(np.arange(lo, hi) * float(step), t.astype(float), np.concatenate([p["v"], p["v1"]])[u]))
        d, acc = series[0], series[1] - pdf["mean"].iloc[0]
        before, acc = (None, acc) if k0 == 0 else (acc[0], acc[1:])
        v = _running(acc, before, dt)
        x = _running(v, None if before is None else 0.0, dt)
        own, j = d[k0 - left : k1 - left], np.arange(k1 - k0)
        row = [*head, at, n, k0, k1 - k0, d, acc, before, own.sum(), own @ j, v.sum(), v @ j, v[-1], x.sum(), x @ j, x[-1]]
        return pd.DataFrame([row], columns=[*keys, *COLUMNS])

    sums = "sd double, sjd double, sv double, sjv double, ev double, sx double, sjx double, ex double"
    blocks = materialize(placed.groupBy(*keys, "blk").applyInPandas(sample, types + f"blk bigint, n bigint, k0 bigint, m bigint, d array<double>, acc array<double>, before double, {sums}"), "grid")
    lines = blocks.drop("d", "acc", "before").groupBy(*keys).applyInPandas(_carry(keys, dt), types + "blk bigint, d0 double, d1 double, v0 double, v1 double, x0 double, x1 double, x2 double")
    lags = np.arange(-most, most + 1)

    def products(batches):
        for pdf in batches:
            parts = []
            for r in pdf.to_dict("records"):
                n, k0, m, d, acc = int(r["n"]), int(r["k0"]), int(r["m"]), np.asarray(r["d"], float), np.asarray(r["acc"], float)
                before = None if k0 == 0 else r["before"]
                left, j = max(0, k0 - halo), np.arange(m)
                v = _running(acc, before, dt)
                x = _running(v, None if before is None else 0.0, dt)
                win = smoothing_window(n, dt)
                ends = left == 0, left + len(d) == n
                pairs = {
                    "velocity": (smoothed_derivative(d, win, 1, dt, *ends), v + r["v0"] + r["v1"] * j),
                    "accel": (smoothed_derivative(d, win, 2, dt, *ends), acc),
                    "position": (d - r["d0"] - r["d1"] * (left + np.arange(len(d))), x + r["x0"] + r["x1"] * j + r["x2"] * j * j),
                }
                lo, hi = max(0, k0 - most), min(n, k0 + m + most)
                pad = (lo - (k0 - most), k0 + m + most - hi)
                for method, (p, q) in pairs.items():
                    own = p[k0 - left : k0 - left + m]
                    wide = np.pad(p[lo - left : hi - left], pad)
                    there = np.pad(np.ones(hi - lo), pad)
                    run = np.concatenate([[0.0], np.cumsum(wide)])
                    count = np.concatenate([[0.0], np.cumsum(there)])
                    sab, sb = np.correlate(wide, q, "valid"), np.correlate(there, q, "valid")
                    sa, c = run[m:] - run[:-m], count[m:] - count[:-m]
                    part = pd.DataFrame({"lag": lags.astype(np.int32), "sab": sab, "sa": sa, "sb": sb, "c": c})
                    part["method"], part["ta"], part["tb"], part["taa"], part["tbb"], part["n"] = method, own.sum(), q.sum(), own @ own, q @ q, float(m)
                    for k in keys:
                        part[k] = r[k]
                    parts.append(part)
            if parts:
                yield pd.concat(parts)[[*keys, "method", "lag", *names]]

    names = ["sab", "sa", "sb", "c", "ta", "tb", "taa", "tbb", "n"]
    ready = blocks.select(*keys, "blk", "n", "k0", "m", "d", "acc", "before").join(lines, [*keys, "blk"])
    got = ready.mapInPandas(products, types + "method string, lag int, " + ", ".join(f"{x} double" for x in names))
    s = got.groupBy(*keys, "method", "lag").agg(*[F.sum(x).alias(x) for x in names]).where("c > 0")
    s = s.withColumns({"ma": F.col("ta") / F.col("n"), "mb": F.col("tb") / F.col("n")})
    sd = lambda p: F.sqrt(F.greatest(F.lit(0.0), F.col(f"t{p}{p}") / F.col("n") - F.col(f"m{p}") * F.col(f"m{p}")))
    unit = lambda p: F.when(sd(p) > 1e-12, sd(p)).otherwise(F.lit(1.0))
    r = F.col("sab") - F.col("ma") * F.col("sb") - F.col("mb") * F.col("sa") + F.col("c") * F.col("ma") * F.col("mb")
    return s.select(*keys, "method", "lag", (r / (unit("a") * unit("b") * F.col("n"))).alias("r"))


def offset_by_correlation(a: DataFrame, b: DataFrame, keys: list[str], hz: int = 200, most_s: float = 1.0, block: int = BLOCK) -> DataFrame:
    """keys, method, lag, r, shift, offset, median, spread: for each of ``ORDERS`` the lag of the largest |r|, refined by
    a parabola (shift), and the offset t_b − t_a in seconds; median and spread (largest less smallest) of the three."""
    corr = materialize(lag_correlations(a, b, keys, hz, most_s, block), "corr")
    one = peak_of_correlation(corr, [*keys, "method"]).withColumn("offset", -F.col("shift") / F.lit(float(hz)))
    three = one.groupBy(*keys).agg(F.median("offset").alias("median"), (F.max("offset") - F.min("offset")).alias("spread"))
    return one.join(three, keys)


def turning_points(readings: DataFrame, keys: list[str], smooth_s: float = 0.3, apart_s: float = 0.5, share: float = 0.2) -> DataFrame:
    """keys, id, t, kind (1 maximum, -1 minimum) of smoothed series (keys, t in µs, id, v; each reading once).

    Windows are seconds, turned into samples by each series' own median period; a turning point rises or falls by at least
    ``share`` of the range from the 5th to the 95th percentile of the smoothed series. Series with fewer than 3 readings have none."""
    indexed = row_index(readings, keys, "t", "id")
    period = sample_period(indexed, keys).where("n >= 3")
    sized = period.select(*keys, "n", samples(smooth_s, F.col("period")).alias("w"), samples(apart_s, F.col("period")).alias("far"))
    smooth = materialize(smoothed(indexed.join(sized, keys), keys, "v", "w", "n"), "smooth")
    spread = exact_percentiles(smooth, keys, "v", {"p05": 0.05, "p95": 0.95})
    high = F.greatest(F.lit(share) * (F.col("p95") - F.col("p05")), F.lit(1e-9))
    ready = smooth.join(spread.select(*keys, high.alias("high")), keys)
    found = series_peaks(ready, keys, "id", "far", "high", both=True)
    return found.join(smooth.select(*keys, "id", "t"), [*keys, "id"])


def offsets_of_pairs(pairs: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """keys, n, offset, std: pairs (``diff``) farther than ``tolerance`` from their median are left out; median, population
    deviation and number of the rest."""
    mid = exact_percentiles(pairs, keys, "diff", {"mid": 0.5})
    kept = pairs.join(mid, keys).where(F.abs(F.col("diff") - F.col("mid")) <= tolerance).select(*keys, "diff")
    return exact_percentiles(kept, keys, "diff", {"offset": 0.5}).join(kept.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("diff").alias("std")), keys)


def offset_by_reversals(points: DataFrame, keys: list[str], sensor: str, pairs: list[tuple[str, str]], reach: int, tolerance: int) -> DataFrame:
    """keys, other, ref, n, offset, std (µs): how much later ``other`` is stamped than ``ref``, by turning points (``points``:
    keys, sensor, id, t) that are each other's nearest."""
    out = None
    for ref, other in pairs:
        met = mutual_nearest(points.where(F.col(sensor) == ref), points.where(F.col(sensor) == other), keys, "t", "id", reach)
        one = offsets_of_pairs(met, keys, tolerance).select(*keys, F.lit(other).alias("other"), F.lit(ref).alias("ref"), "n", "offset", "std")
        out = one if out is None else out.unionByName(one)
    return out
