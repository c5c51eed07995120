"""Implausible readings per source: a local-level Kalman filter proposes, exact rules confirm.

Per series the usable readings (time not null, value finite, equal rows once) are taken in order of time;
of equal times the smaller id comes first. The filter works in units of the series' median absolute
successive difference (its normal behaviour): readings outside the source's limits, and those whose standardised innovation
passes a threshold, are flagged and withheld from the update; after ``RESTART`` flagged readings in a row it starts again from
the last one. Where the innovations' variance vanishes (``STILL`` in a row next to nothing) the sensor may be stuck.

Why nothing confirmed is missed. Spikes: the first reading of a spike group differs by more than 12 units from
its predecessor. The gain is above 0.9 and the threshold, even after the longest allowed withholding, is
below 6 units, so one of the two is always flagged; every reading within ``REACH`` of a flagged one is then
judged by the exact rule. Runs of eight equal readings: either the filter takes the first one in, and each innovation after
it is less than a tenth of the one before, or it withholds three and starts again from the fourth; the last three
innovations are below 0.01 units in both cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.timeblocks import block_context, pack_blocks
from pointloom.session import materialize

STUCK, GROUP, FACTOR = 8, 3, 12.0
THRESHOLD, GAIN_NOISE, RESTART, REACH = 2.5, 0.05, 4, 4
STILL, NOTHING = 3, 0.01
CONTEXT = 12
_BIN_SHIFT = 45  # IEEE bits below the bin: 128 bins an octave


def _columns(column: pa.ChunkedArray | pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """t, id, v of one row of a list<struct> column."""
    lo, hi = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    s = column.values.slice(lo, hi - lo)
    return tuple(s.field(k).to_numpy(zero_copy_only=False) for k in range(3))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        rs = batch.column("rs")
        for row in range(batch.num_rows):
            yield batch, row, np.abs(np.diff(_columns(rs, row)[2]))


def _bins(d: np.ndarray) -> np.ndarray:
    return d.view(np.int64) >> _BIN_SHIFT


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[str, str, np.ndarray, np.ndarray]] = []
    for batch, row, d in _differences(batches):
        b, n = np.unique(_bins(d), return_counts=True)
        out.append((batch.column("session_id")[row].as_py(), batch.column("channel")[row].as_py(), b, n))
        if len(out) >= 64:
            yield _stack(out)
            out = []
    if out:
        yield _stack(out)


def _stack(rows: list) -> pa.RecordBatch:
    sizes = [len(r[2]) for r in rows]
    index = np.repeat(np.arange(len(rows)), sizes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()).take(pa.array(index)),
            pa.array([r[1] for r in rows], pa.string()).take(pa.array(index)),
            pa.array(np.concatenate([r[2] for r in rows])),
            pa.array(np.concatenate([r[3] for r in rows]).astype(np.int64)),
        ],
        ["session_id", "channel", "key", "n"],
    )


def _in_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []

    def stacked() -> pa.RecordBatch:
        part = _stack(out)
        return part.append_column("bin", pa.array(_bins(part.column("key").to_numpy())))

    for batch, row, d in _differences(batches):
        b = _bins(d)
        lo, hi = batch.column("lo_bin")[row].as_py(), batch.column("hi_bin")[row].as_py()
        v, n = np.unique(d[(b == lo) | (b == hi)], return_counts=True)
        out.append((batch.column("session_id")[row].as_py(), batch.column("channel")[row].as_py(), v, n))
        if len(out) >= 64:
            yield stacked()
            out = []
    if out:
        yield stacked()


def median_abs_difference(blocks: DataFrame, context: DataFrame) -> DataFrame:
    """Exact median of |successive difference| per (session_id, channel): counts by 128 bins an octave,
    then counts of the distinct values inside the one or two bins that hold the middle ranks. All sums are
    combined before they are shuffled; no series is gathered or sorted as a whole."""
    keys = ["session_id", "channel"]
    crossing = context.where(F.size("prev") > 0).select(
        *keys, "block", F.expr("array(element_at(prev, -1), first)").alias("rs")
    )
    pairs = blocks.select(*keys, "rs").unionByName(crossing.select(*keys, "rs"))
    hist = (
        pairs.mapInArrow(_histogram, "session_id string, channel string, key bigint, n bigint")
        .groupBy(*keys, "key").agg(F.sum("n").alias("n"))
    )
    w = Window.partitionBy(*keys).orderBy("key")
    ranked = hist.select(
        *keys, "key", (F.sum("n").over(w) - F.col("n")).alias("below"), "n", F.sum("n").over(Window.partitionBy(*keys)).alias("total")
    )
    lower, upper = F.expr("(total - 1) div 2"), F.expr("total div 2")
    holds = lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("n"))
    mid = materialize(
        ranked.groupBy(*keys).agg(
            F.max(F.when(holds(lower), F.col("key"))).alias("lo_bin"),
            F.max(F.when(holds(upper), F.col("key"))).alias("hi_bin"),
            F.max(F.when(holds(lower), lower - F.col("below"))).alias("lo_rank"),
            F.max(F.when(holds(upper), upper - F.col("below"))).alias("hi_rank"),
        ),
        "median-bins",
    )
    inside = (
        pairs.join(mid, keys)
        .select(*keys, "lo_bin", "hi_bin", "rs")
        .mapInArrow(_in_bins, "session_id string, channel string, key double, n bigint, bin bigint")
        .groupBy(*keys, "bin", "key").agg(F.sum("n").alias("n"))
    )
    wb = Window.partitionBy(*keys, "bin").orderBy("key")
    placed = inside.withColumn("below", F.sum("n").over(wb) - F.col("n")).join(mid, keys)
    at = lambda b, r: (F.col("bin") == F.col(b)) & (F.col("below") <= F.col(r)) & (F.col(r) < F.col("below") + F.col("n"))
    return placed.groupBy(*keys).agg(
        ((F.max(F.when(at("lo_bin", "lo_rank"), F.col("key"))) + F.max(F.when(at("hi_bin", "hi_rank"), F.col("key")))) / 2).alias("mad")
    )


def kalman_flags(v: np.ndarray, unit: float, lo: float = -np.inf, hi: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(flags, still) of a random-walk filter over ``v``; process variance 1 and measurement variance ``GAIN_NOISE``
    in squared ``unit``. Flagged readings are withheld; ``RESTART`` in a row start the filter anew. ``still``: readings at
    which the last ``STILL`` innovations have a variance of next to nothing. A series without a unit takes 1."""
    flags, still = np.zeros(len(v), bool), np.zeros(len(v), bool)
    if not len(v):
        return flags, still
    out = ((v < lo) | (v > hi)).tolist()
    scaled, limit, least = (v / (unit if unit > 0 else 1.0)).tolist(), THRESHOLD * THRESHOLD, NOTHING * NOTHING
    x, p, held, calm = scaled[0], GAIN_NOISE, 0, 0
    flags[0] = out[0]
    for i in range(1, len(scaled)):
        p = min(p + 1.0, RESTART + GAIN_NOISE)
        s, e = p + GAIN_NOISE, scaled[i] - x
        calm = calm + 1 if e * e < least else 0
        if calm >= STILL:
            still[i] = True
        if out[i] or e * e > limit * s:
            flags[i] = True
            held += 1
            if held < RESTART:
                continue
            x, p = scaled[i], GAIN_NOISE
        else:
            g = p / s
            x += g * e
            p *= 1 - g
        held = 0
    return flags, still


def stuck_runs(v: np.ndarray, still: np.ndarray) -> np.ndarray:
    """Readings in runs of ``STUCK`` or more equal ones, of which the filter found at least one still."""
    if not len(v):
        return np.zeros(0, bool)
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    length = np.diff(np.r_[start, len(v)])
    return np.repeat((length >= STUCK) & np.logical_or.reduceat(still, start), length)


def confirmed_spikes(v: np.ndarray, near: np.ndarray, unit: float) -> np.ndarray:
    """Of the readings in ``near``: those in a group of at most ``GROUP`` successive readings which all differ
    from the reading before and the one after by more than ``FACTOR`` units, these two differing by less."""
    out, limit = np.zeros(len(v), bool), FACTOR * unit
    for size in range(1, GROUP + 1):
        if len(v) < size + 2:
            break
        before, after = v[: len(v) - size - 1], v[size + 1 :]
        ok = np.abs(before - after) < limit
        for k in range(size):
            mid = v[1 + k : len(v) - size + k]
            ok &= (np.abs(mid - before) > limit) & (np.abs(mid - after) > limit)
        for i in np.flatnonzero(ok):
            out[i + 1 : i + 1 + size] = True
    return out & near


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernel = np.ones(2 * REACH + 1, int)
    for batch in batches:
        ids, channels = [], []
        for row in range(batch.num_rows):
            before, own, after = (_columns(batch.column(c), row) for c in ("prev", "rs", "next"))
            v = np.concatenate([before[2], own[2], after[2]])
            lo, hi, unit = (batch.column(c)[row].as_py() for c in ("lo", "hi", "mad"))
            flags, still = kalman_flags(v, unit or 0.0, -np.inf if lo is None else lo, np.inf if hi is None else hi)
            near = np.convolve(flags, kernel, "same")[: len(v)] > 0 if len(v) > len(kernel) else np.full(len(v), flags.any())
            bad = stuck_runs(v, still) | confirmed_spikes(v, near, unit or 0.0)
            if lo is not None:
                bad |= flags & (v < lo)
            if hi is not None:
                bad |= flags & (v > hi)
            hit = own[1][bad[len(before[2]) : len(before[2]) + len(own[2])]]
            ids.append(hit)
            channels += [batch.column("channel")[row].as_py()] * len(hit)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64), pa.int64()), pa.array(channels, pa.string())], ["sample_id", "channel"]
        )


def implausible_readings(readings: DataFrame, limits: DataFrame, block_us: int = 30_000_000) -> DataFrame:
    """``readings``: session_id, channel, t (bigint µs), id, v. ``limits``: session_id, channel, lo, hi (either
    may be null: no limit). Out: sample_id, channel, one row per implausible reading.

    Nulls: a null time or value, NaN and ±inf are no readings; a null session makes no series. Readings of
    one time are ordered by id. A series whose median difference is 0 has no spikes by definition (nothing
    differs by less than 0). An empty table gives no rows.
    """
    keys = ["session_id", "channel"]
    blocks = materialize(pack_blocks(readings.where(F.col("session_id").isNotNull()), keys, block_us), "blocks")
    context = materialize(
        block_context(blocks, keys, CONTEXT).join(blocks.select(*keys, "block", F.col("rs")[0].alias("first")), [*keys, "block"]), "context"
    )
    facts = materialize(
        blocks.select(*keys).distinct().join(median_abs_difference(blocks, context), keys, "left").join(limits, keys, "left"), "facts"
    )
    return (
        blocks.join(context.drop("first"), [*keys, "block"])
        .join(facts, keys)
        .select("channel", "prev", "rs", "next", "lo", "hi", "mad")
        .mapInArrow(_judge, "sample_id bigint, channel string")
    )
