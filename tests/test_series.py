"""Problems 2 and 5 and the series operators against brute force on small fixtures."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.operators import regrid, series, spikes
from pointloom.operators.percentiles import exact_percentiles

READ = "session_id string, channel string, t bigint, id bigint, v double"
LIMITS = "session_id string, channel string, lo double, hi double"


def brute_spikes(v):
    d = np.abs(np.diff(v))
    limit = 12 * np.median(d) if len(d) else 0.0
    out = set()
    for n in (1, 2, 3):
        for i in range(1, len(v) - n):
            a, b, g = v[i - 1], v[i + n], v[i : i + n]
            if abs(a - b) < limit and all(abs(x - a) > limit and abs(x - b) > limit for x in g):
                out |= set(range(i, i + n))
    run = 0
    for i in range(len(v)):
        run = run + 1 if i and v[i] == v[i - 1] else 1
        if run >= 8:
            out |= set(range(i - run + 1, i + 1))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 0.2, 0.3, 5.0, -5.0, 9.0, 40.0]), min_size=1, max_size=60))
def test_flags_reach_every_spike(values):
    v = np.array(values)
    d = np.abs(np.diff(v))
    unit = float(np.median(d)) if len(d) else 0.0
    flags, still = spikes.kalman_flags(v, unit)
    near = np.array([flags[max(0, i - spikes.REACH) : i + spikes.REACH + 1].any() for i in range(len(v))])
    found = spikes.confirmed_spikes(v, near, unit) | spikes.stuck_runs(v, still)
    assert set(np.flatnonzero(found)) == brute_spikes(v)


def test_spikes_across_blocks_with_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows, truth = [], set()
    for s in ("a", "b"):
        v = [math.sin(i / 9) + rng.gauss(0, 0.01) for i in range(400)]
        for at, n in ((57, 1), (120, 2), (199, 3), (200, 2), (398, 1)):
            for k in range(n):
                v[at + k] = 30.0 + k
        v[300:312] = [0.5] * 12
        for i in brute_spikes(np.array(v)):
            truth.add((hash(s) % 1000 * 0 + ord(s) * 1000 + i, "x"))
        rows += [(s, "x", i * 1_000_000 + rng.randrange(900_000), ord(s) * 1000 + i, v[i]) for i in range(400)]
    rows += rows[50:60]
    rows += [("a", "x", None, 1, 9.0), ("a", "x", 5, 2, None), ("a", "x", 6, 3, float("nan")), ("a", "x", 7, 4, float("inf")), (None, "x", 8, 5, 99.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, READ).withColumn("extra", F.lit(1))
    limits = spark.createDataFrame([("a", "x", None, None)], LIMITS)
    got = {tuple(r) for r in spikes.implausible_readings(df, limits, block_us=20_000_000).collect()}
    assert got == truth and len(truth) > 20


def test_limits_and_empty(spark):
    df = spark.createDataFrame([("a", "x", i, i, float(i)) for i in range(5)], READ)
    limits = spark.createDataFrame([("a", "x", 1.0, 3.0)], LIMITS)
    assert {r["sample_id"] for r in spikes.implausible_readings(df, limits).collect()} == {0, 4}
    assert spikes.implausible_readings(df.limit(0), limits).count() == 0


def test_exact_median_of_differences(spark):
    rng = np.random.default_rng(1)
    rows = [(s, "x", int(i * 500_000), i, float(v)) for s in "ab" for i, v in enumerate(np.round(rng.standard_normal(701).cumsum(), 4))]
    from pointloom.operators.timeblocks import block_context, pack_blocks

    blocks = pack_blocks(spark.createDataFrame(rows, READ), ["session_id", "channel"], 10_000_000).persist()
    ctx = block_context(blocks, ["session_id", "channel"], 12).join(blocks.select("session_id", "channel", "block", F.col("rs")[0].alias("first")), ["session_id", "channel", "block"])
    got = {r["session_id"]: r["mad"] for r in spikes.median_abs_difference(blocks, ctx).collect()}
    for s in "ab":
        v = np.array([r[4] for r in rows if r[0] == s])
        assert got[s] == pytest.approx(np.median(np.abs(np.diff(v))), abs=1e-12)


def _regular(spark, rows, slot=500_000, **kw):
    df = spark.createDataFrame(rows, "sensor string, session_id string, t bigint, id bigint, v double")
    return sorted(map(tuple, regrid.regular_series(df, {"lidar": slot}, **kw).collect()), key=lambda r: (r[1], r[2]))


def test_slots_gaps_and_missing_marks(spark):
    rows = [("lidar", "a", int(i * 100_000), i, float(i)) for i in range(50)]
    rows += [("lidar", "a", 400_000_000 + int(i * 100_000), 100 + i, 5.0) for i in range(20)] + rows[:5]
    rows += [("lidar", "a", None, 7, 1.0), ("lidar", "a", 9, 8, float("nan")), ("lidar", None, 9, 9, 1.0), ("lidar", "one", 3, 10, 2.0)]
    got = _regular(spark, rows, slots_per_block=6)
    a = [r for r in got if r[1] == "a"]
    assert [r[2] for r in a] == list(range(0, 804))
    assert [r[2] for r in a if not r[7]] == [*range(10), *range(800, 804)]
    assert [r for r in got if r[1] == "one"][0][2:4] == (0, 0.25)
    assert all(math.isfinite(r[4]) and math.isfinite(r[5]) for r in got)
    assert max(r[5] for r in a if r[7]) > max(r[5] for r in a if not r[7])
    assert _regular(spark, [("lidar", "x", None, 1, 1.0)]) == []


def test_block_size_does_not_matter(spark):
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.uniform(0.05, 0.15, 300))
    rows = [("lidar", "a", int(x * 1e6), i, float(np.sin(x) + rng.normal(0, 0.01))) for i, x in enumerate(t)]
    a, b = _regular(spark, rows, slots_per_block=10), _regular(spark, rows, slots_per_block=1000)
    assert [r[:4] for r in a] == [r[:4] for r in b]
    assert max(abs(x[4] - y[4]) for x, y in zip(a, b, strict=True)) < 0.02


def test_held_out_readings_are_predicted(spark):
    rng = np.random.default_rng(2)
    t = np.arange(0, 60, 0.1)
    v = np.sin(t / 2) + rng.normal(0, 0.02, len(t))
    kept = [(x, y, i) for i, (x, y) in enumerate(zip(t, v, strict=True)) if not 20 <= x < 21]
    got = _regular(spark, [("lidar", "a", int(round(x * 1e6)), i, float(y)) for x, y, i in kept])
    err = [abs(r[4] - np.sin(r[3] / 2)) for r in got]
    assert float(np.mean(err)) < 0.02 and max(err) < 0.2
    hole = [r for r in got if r[7]]
    assert [r[2] for r in hole] == [40, 41] and all(abs(r[4] - np.sin(r[3] / 2)) < 4 * r[5] + 0.05 for r in hole)


def test_percentiles_with_ties_and_nans(spark):
    rows = [("a", float(x)) for x in [1, 1, 1, 2, 7, -4, 1e9, 0]] + [("b", 3.0), ("c", float("nan")), ("a", None)]
    got = {r["g"]: (r["p"], r["q"]) for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p": 0.5, "q": 0.9}).collect()}
    v = [1, 1, 1, 2, 7, -4, 1e9, 0]
    assert set(got) == {"a", "b"} and got["b"] == (3.0, 3.0)
    assert got["a"] == pytest.approx((np.percentile(v, 50), np.percentile(v, 90)))


def test_windows_do_not_depend_on_blocks(spark):
    rows = [("a", i * 7, i, float((i * 37) % 11)) for i in range(100)]
    df = series.row_index(spark.createDataFrame(rows, "k string, t bigint, id bigint, v double"), ["k"], "t", "id", bin_us=50)
    assert sorted(r["idx"] for r in df.collect()) == list(range(100))
    run = lambda b: sorted((r["id"], round(r["m"], 9)) for r in series.windowed(df, ["k"], {"m": series.moving_average("v", 4)}, 2, 2, block=b).collect())
    assert run(7) == run(1000)
    v = np.array([r[3] for r in rows])
    assert [m for _, m in run(7)] == pytest.approx(np.convolve(v, np.ones(4) / 4, "same").tolist())
    total = lambda b: sorted((r["id"], r["s"]) for r in series.running_sum(df, ["k"], "v", "s", block=b).collect())
    assert total(9) == total(1000)


def test_regular_series_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    t = np.cumsum(rng.uniform(0.06, 0.14, 3000))
    t[1500:] += 40.0  # a gap
    v = np.sin(t / 2) + 0.02 * rng.standard_normal(len(t))
    rows = [("lidar", "a", int(x * 1e6), i, float(y)) for i, (x, y) in enumerate(zip(t, v, strict=True))]
    df = spark.createDataFrame(rows, "sensor string, session_id string, t bigint, id bigint, v double")
    found = []
    for n in (10, 1000):
        got = regrid.regular_series(df, {"lidar": 500_000}, slots_per_block=n)
        found.append({r["slot"]: (r["value"], r["sd"], r["n"]) for r in got.collect()})
    assert found[0].keys() == found[1].keys()
    worst = max(abs(a - b) for k in found[0] for a, b in zip(found[0][k], found[1][k], strict=True))
    assert worst < 1e-6
    near = [abs(found[0][k][0] - math.sin((k + 0.5) * 0.25)) for k in found[0] if found[0][k][2] > 2]
    assert np.mean(near) < 0.02
