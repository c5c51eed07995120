"""Offset by correlation against the whole series in plain numpy."""

import numpy as np

from pointloom.operators import offsets

READ = "s string, t bigint, id bigint, v double"


def line_off(y):
    k = np.arange(len(y))
    return y - np.polyval(np.polyfit(k, y, 1), k)


def derivative(x, win, order, dt):
    """A parabola fitted to the window around every sample, or to the outermost one."""
    out = np.empty(len(x))
    for i in range(len(x)):
        lo = min(max(0, i - win // 2), len(x) - win)
        p = np.polyfit(np.arange(lo, lo + win) - i, x[lo : lo + win], 2)
        out[i] = p[1] / dt if order == 1 else 2 * p[0] / dt**2
    return out


def whole(ta, va, tb, vb, hz, most):
    g0, g1, dt = max(ta[0], tb[0]), min(ta[-1], tb[-1]), 1 / hz
    grid = np.arange(g0, g1, 1_000_000 // hz)
    d, acc = np.interp(grid, ta, va), np.interp(grid, tb, vb - vb.mean())
    cum = lambda y: np.concatenate([[0.0], np.cumsum((y[1:] + y[:-1]) * dt / 2)])
    vel = line_off(cum(acc))
    win = max(5, min(len(d) // 2, int(0.4 * hz)))
    win += win % 2 == 0
    out = {}
    for m, p, q in (("velocity", derivative(d, win, 1, dt), vel), ("accel", derivative(d, win, 2, dt), acc), ("position", line_off(d), line_off(cum(vel)))):
        z = [(y - y.mean()) / y.std() for y in (p, q)]
        full = np.correlate(z[0], z[1], "full") / len(p)
        for lag in range(-most, most + 1):
            out[m, lag] = full[lag + len(p) - 1]
    return out


def made(seconds, later, seed=0):
    """A swinging distance at 10 Hz and its acceleration at 100 Hz, ``later`` seconds late; a gap in either."""
    rng = np.random.default_rng(seed)
    f, ph = rng.uniform(0.3, 0.9, 5), rng.uniform(0, 6, 5)
    w = 2 * np.pi * f
    ta = np.sort(rng.choice(np.arange(0, seconds * 1_000_000, 1000), seconds * 10, replace=False))
    tb = np.sort(rng.choice(np.arange(1_500_000, seconds * 1_000_000, 1000), seconds * 100, replace=False))
    tb = tb[(tb < 4_000_000) | (tb > 4_600_000)]
    va = 3 + np.sin(np.outer(ta / 1e6, w) + ph).sum(axis=1)
    vb = 0.2 - (w**2 * np.sin(np.outer(tb / 1e6 - later, w) + ph)).sum(axis=1)
    return ta, va, tb, vb


def frames(spark, cases):
    rows = [[(s, int(t), i, float(v)) for s, c in cases.items() for i, (t, v) in enumerate(zip(c[k], c[k + 1], strict=True))] for k in (0, 2)]
    return [spark.createDataFrame(r, READ) for r in rows]


def test_offset_of_range_and_inertia(spark):
    """0.7 s is 7 range readings: beyond the 5 rows that were searched before."""
    cases = {"late": made(40, 0.7), "early": made(30, -0.31, 1), "short": tuple(x[:4] for x in made(20, 0.0))}
    a, b = frames(spark, cases)
    got = {(r["s"], r["method"]): r for r in offsets.offset_by_correlation(a, b, ["s"], block=1000).collect()}
    assert {s for s, _ in got} == {"late", "early"} and len(got) == 6
    for (s, _), r in got.items():
        want = {"late": 0.7, "early": -0.31}[s]
        assert abs(r["offset"] - want) < 0.06 and abs(r["median"] - want) < 0.03 and r["spread"] < 0.1


def test_blocks_equal_the_whole_series(spark):
    cases = {"x": made(33, 0.4, 2), "tiny": tuple(y[k] for y, k in zip(made(20, 0.1, 3), (slice(15, 26), slice(15, 26), slice(None), slice(None)), strict=True))}
    a, b = frames(spark, cases)
    got = {}
    for r in offsets.lag_correlations(a, b, ["s"], block=700).collect():
        got.setdefault(r["s"], {})[r["method"], r["lag"]] = r["r"]
    for s, c in cases.items():
        want = whole(*c, 200, 200)
        assert got[s].keys() == want.keys()
        assert max(abs(got[s][k] - want[k]) for k in want) < 1e-7


def test_query_searches_a_second_in_three_orders(spark, sf):
    from pointloom.plans.reference_queries import QUERIES

    rows = QUERIES["correlation_peak"](spark, sf).collect()
    assert rows and {r["method"] for r in rows} == set(offsets.ORDERS)
    assert all(-200 <= r["lag"] <= 200 for r in rows)


def test_reversals_find_a_delay(spark):
    """Three sensors of one motion, two of them late by known times of either sign."""
    from pointloom.operators.offsets import offset_by_reversals, turning_points

    rng = np.random.default_rng(7)
    turns = np.cumsum(rng.uniform(2.0, 3.0, 30))
    rows, n = [], 0
    for sensor, hz, late in (("lidar", 10, 0.0), ("camera", 30, 0.12), ("imu", 200, -0.08)):
        t = np.arange(0, turns[-1], 1 / hz)
        v = np.interp(t, np.r_[0, turns], np.arange(31) % 2) + 0.01 * rng.standard_normal(len(t))
        rows += [("a", sensor, int((x + late + 1) * 1e6), (n := n + 1), float(y)) for x, y in zip(t, v, strict=True)]
    df = spark.createDataFrame(rows, "session string, sensor string, t bigint, id bigint, v double")
    found = turning_points(df, ["session", "sensor"])
    got = {r["other"]: r for r in offset_by_reversals(found, ["session"], "sensor", [("lidar", "camera"), ("lidar", "imu")], 2_000_000, 500_000).collect()}
    assert abs(got["camera"]["offset"] - 120_000) < 30_000 and abs(got["imu"]["offset"] + 80_000) < 30_000 and got["imu"]["n"] > 20
    assert turning_points(df.limit(2), ["session", "sensor"]).count() == 0
