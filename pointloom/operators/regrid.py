"""Irregular series onto a regular grid: Kalman smoother with a continuous-time local trend.

State: level and slope; between two times the slope does a Wiener walk of intensity q, readings carry noise
of variance r. Both are estimated once per source, from second differences counted by fine bins over all its blocks.
Forward filter and backward smoother run over readings and grid times together; grid times are unobserved, so the smoothed
level there is the filled value and its variance the uncertainty. Every block is smoothed with up to ``CONTEXT`` readings
before and after it: the filter forgets by a third or more with every reading of the series at hand, so what
lies beyond changes values by less than 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.spikes import _BIN_SHIFT, _bins, _columns
from pointloom.operators.timeblocks import block_context, pack_blocks
from pointloom.session import materialize, release, spread

CONTEXT, REACH = 64, 8
COARSER = 2
SCHEMA = "sensor string, session_id string, slot bigint, t double, value double, sd double, n bigint, missing boolean"


def _residuals(t: np.ndarray, v: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of readings from the line through their neighbours, and squared changes of slope over pairs four readings
    apart per second; those that end in the first ``before`` readings are left out, as another block has them."""
    if len(t) < 3:
        return np.zeros(0), np.zeros(0)
    h = np.maximum(np.diff(t), 1e-6)
    a = h[1:] / (h[:-1] + h[1:])
    e = np.abs(v[1:-1] - a * v[:-2] - (1 - a) * v[2:])[max(before - 2, 0) :]
    if len(t) < 9:
        return e, np.zeros(0)
    slope = (v[4:] - v[:-4]) / np.maximum(t[4:] - t[:-4], 1e-6)
    return e, ((slope[4:] - slope[:-4]) ** 2 / np.maximum(t[4:-4] - t[:-8], 1e-6))[max(before - 8, 0) :]


def _residual_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by bin, combined over all blocks of a source in the batch."""
    for batch in batches:
        counted: dict[tuple, list] = {}
        names = [batch.column(c).to_pylist() for c in ("sensor", "session_id")]
        for row, source in enumerate(zip(*names, strict=True)):
            before, own = (_columns(batch.column(c), row) for c in ("prev", "rs"))
            t, v = np.concatenate([before[0], own[0]]), np.concatenate([before[2], own[2]])
            for kind, x in enumerate(_residuals((t - t[0]) / 1e6, v, len(before[0]))):
                counted.setdefault((*source, kind), []).append(np.unique(_bins(np.ascontiguousarray(x, np.float64)) >> COARSER, return_counts=True))
        keys, sums = [], []
        for parts in counted.values():
            key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            keys.append(key)
            sums.append(np.bincount(at, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64))
        which = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]).astype(np.int64))
        heads = [pa.array(list(c), t).take(which) for c, t in zip(zip(*counted, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)] if counted else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int32())]
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (keys, sums)]
        yield pa.RecordBatch.from_arrays([*heads, *flat], ["sensor", "session_id", "kind", "key", "n"])


def noise_scales(joined: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r_bin, q_bin: the bins (``spikes._bins``, four taken together: 32 an octave) that hold the medians over all blocks of a source, null where there is
    too little to tell. Counts are combined before they are shuffled."""
    hist = joined.select(*keys, "prev", "rs").mapInArrow(_residual_bins, "sensor string, session_id string, kind int, key bigint, n bigint").groupBy(*keys, "kind", "key").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "kind")
    at = hist.withColumn("upto", F.sum("n").over(w.orderBy("key"))).withColumn("total", F.sum("n").over(w)).where(F.col("upto") * 2 >= F.col("total"))
    enough = lambda kind, least: F.min(F.when((F.col("kind") == kind) & (F.col("total") >= least), F.col("key")))
    return at.groupBy(*keys).agg(enough(0, 4).alias("r_bin"), enough(1, 1).alias("q_bin"))


def _scales(r_bin: int | None, q_bin: int | None) -> tuple[float, float]:
    """(r, q) from the middles of the median bins."""
    shift = _BIN_SHIFT + COARSER
    middle = lambda k: float(((np.array([k], np.int64) << shift) + (1 << (shift - 1))).view(np.float64)[0])
    r = 1e-4 if r_bin is None else max((middle(r_bin) * 1.4826) ** 2 / 1.5, 1e-10)
    return r, 1.0 if q_bin is None else max(middle(q_bin) * 2.2, 1e-6)


def smooth(ts: list[np.ndarray], ys: list[np.ndarray], rs: list[float], qs: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Smoothed (level, variance) of several independent series at once; NaN in ``ys`` is an unobserved time.
    The loop runs over steps, each step over all series."""
    width, m = len(ts), max(map(len, ts))
    t = np.stack([np.r_[x, np.full(m - len(x), x[-1])] for x in ts])
    y = np.stack([np.r_[x, np.full(m - len(x), np.nan)] for x in ys])
    r, q = np.asarray(rs), np.asarray(qs)
    seen = ~np.isnan(y)
    first = np.argmax(seen, axis=1)
    level = y[np.arange(width), first].copy()
    level[~seen.any(axis=1)] = 0.0
    slope = np.zeros(width)
    a, b, c = np.full(width, 1e6), np.zeros(width), np.full(width, 1e4)
    keep = {k: np.empty((m, width)) for k in ("l", "s", "a", "b", "c", "pl", "ps", "pa", "pb", "pc")}
    y0 = np.where(seen, y, 0.0)
    dt = np.diff(t, axis=1, prepend=t[:, :1])
    for k in range(m):
        h = dt[:, k]
        level = level + h * slope
        a, b, c = a + 2 * h * b + h * h * c + q * h**3 / 3, b + h * c + q * h * h / 2, c + q * h
        for name, x in zip(("pl", "ps", "pa", "pb", "pc"), (level, slope, a, b, c), strict=True):
            keep[name][k] = x
        on = seen[:, k]
        if on.any():
            f = np.where(on, 1 / (a + r), 0.0)
            e, ga, gb = y0[:, k] - level, a * f, b * f
            level, slope = level + ga * e, slope + gb * e
            a, b, c = a - ga * a, b - ga * b, c - gb * b
        for name, x in zip(("l", "s", "a", "b", "c"), (level, slope, a, b, c), strict=True):
            keep[name][k] = x
    out_l, out_v = np.empty((m, width)), np.empty((m, width))
    sl, ss, va, vb, vc = (keep[n][m - 1] for n in ("l", "s", "a", "b", "c"))
    out_l[m - 1], out_v[m - 1] = sl, va
    for k in range(m - 2, -1, -1):
        h = dt[:, k + 1]
        fa, fb, fc = keep["a"][k], keep["b"][k], keep["c"][k]
        pa_, pb, pc = keep["pa"][k + 1], keep["pb"][k + 1], keep["pc"][k + 1]
        m00, m01, m10, m11 = fa + h * fb, fb, fb + h * fc, fc
        det = np.maximum(pa_ * pc - pb * pb, 1e-300)
        still = h <= 0
        g00, g01 = (m00 * pc - m01 * pb) / det, (m01 * pa_ - m00 * pb) / det
        g10, g11 = (m10 * pc - m11 * pb) / det, (m11 * pa_ - m10 * pb) / det
        g00, g11 = np.where(still, 1.0, g00), np.where(still, 1.0, g11)
        g01, g10 = np.where(still, 0.0, g01), np.where(still, 0.0, g10)
        el, es = sl - keep["pl"][k + 1], ss - keep["ps"][k + 1]
        da, db, dc = va - pa_, vb - pb, vc - pc
        sl, ss = keep["l"][k] + g00 * el + g01 * es, keep["s"][k] + g10 * el + g11 * es
        va, vb, vc = (
            fa + g00 * g00 * da + 2 * g00 * g01 * db + g01 * g01 * dc,
            fb + g00 * g10 * da + (g00 * g11 + g01 * g10) * db + g01 * g11 * dc,
            fc + g10 * g10 * da + 2 * g10 * g11 * db + g11 * g11 * dc,
        )
        out_l[k], out_v[k] = sl, va
    return [(out_l[: len(x), i], out_v[: len(x), i]) for i, x in enumerate(ts)]


def _regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            jobs = [_job(part, row) for row in range(part.num_rows)]
            jobs = [j for j in jobs if j is not None]
            for at in range(0, len(jobs), 64):
                yield from _emit(jobs[at : at + 64])


def _job(part: pa.RecordBatch, row: int):
    before, own, after = (_columns(part.column(c), row) for c in ("prev", "rs", "next"))
    t0 = part.column("from_slot")[row].as_py()
    slots = np.arange(t0, part.column("to_slot")[row].as_py() + 1)
    if not len(slots):
        return None
    slot_us = part.column("slot_us")[row].as_py()
    us = np.concatenate([before[0], own[0], after[0]])
    v = np.concatenate([before[2], own[2], after[2]])
    grid_us = slots * slot_us + slot_us // 2
    origin = grid_us[0]
    t_read, t_grid = (us - origin) / 1e6, (grid_us - origin) / 1e6
    order = np.argsort(np.r_[t_read, t_grid], kind="stable")
    t = np.r_[t_read, t_grid][order]
    y = np.r_[v, np.full(len(slots), np.nan)][order]
    counts = np.bincount(own[0] // slot_us - slots[0], minlength=len(slots))[: len(slots)] if len(own[0]) else np.zeros(len(slots), np.int64)
    return (part.column("sensor")[row].as_py(), part.column("session_id")[row].as_py(), slots, grid_us / 1e6, counts, t, y, order >= len(v), *_scales(part.column("r_bin")[row].as_py(), part.column("q_bin")[row].as_py()))


def _emit(jobs: list) -> Iterator[pa.RecordBatch]:
    done = smooth([j[5] for j in jobs], [j[6] for j in jobs], [j[8] for j in jobs], [j[9] for j in jobs])
    sizes = [len(j[2]) for j in jobs]
    index = pa.array(np.repeat(np.arange(len(jobs)), sizes))
    n = np.concatenate([j[4] for j in jobs]).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([j[0] for j in jobs], pa.string()).take(index),
            pa.array([j[1] for j in jobs], pa.string()).take(index),
            pa.array(np.concatenate([j[2] for j in jobs])),
            pa.array(np.concatenate([j[3] for j in jobs])),
            pa.array(np.concatenate([d[0][j[7]] for d, j in zip(done, jobs, strict=True)])),
            pa.array(np.sqrt(np.maximum(np.concatenate([d[1][j[7]] for d, j in zip(done, jobs, strict=True)]), 0))),
            pa.array(n),
            pa.array(n == 0),
        ],
        SCHEMA.replace(" boolean", "").replace(" bigint", "").replace(" double", "").replace(" string", "").split(", "),
    )


def regular_series(readings: DataFrame, slots: dict[str, int], slots_per_block: int = 60) -> DataFrame:
    """``readings``: sensor, session_id, t (bigint µs), id, v. ``slots``: slot length in µs per sensor.

    Out, for every slot from the first to the last one with a usable reading, per sensor and session: slot
    (floor(time / length)), t (its middle, s), value and sd (smoothed level there), n (usable readings in it),
    missing (n = 0). Null times, null or non-finite values are no readings, equal rows count once, a null
    session makes no series; a series of one slot gives one row, an empty table none.
    """
    keys = ["sensor", "session_id"]
    length = F.create_map(*[F.lit(x) for kv in slots.items() for x in kv])[F.col("sensor")]
    rows = readings.where(F.col("session_id").isNotNull()).withColumn("slot_us", length.cast("bigint"))
    # time in blocks of a fixed number of slots, whatever the sensor
    scaled = rows.where(F.col("slot_us").isNotNull())
    packed = None
    for sensor, us in slots.items():
        one = pack_blocks(scaled.where(F.col("sensor") == sensor), keys, us * slots_per_block)
        packed = one if packed is None else packed.unionByName(one)
    blocks = materialize(packed, "grid-blocks")
    written = materialize(blocks.join(block_context(blocks, keys, CONTEXT, REACH), [*keys, "block"]), "grid-context")
    release(blocks)
    blocks, joined = written, spread(written)
    scales = noise_scales(joined, keys)
    # blocks without any reading lie between two stored ones: the later one carries the gap before it
    w = Window.partitionBy(*keys).orderBy("block")
    spans = blocks.select(*keys, "block", F.col("rs")[0]["t"].alias("t0"), F.element_at("rs", -1)["t"].alias("t1")).select(
        *keys, "block",
        F.lag("t1").over(w).alias("before"), "t0", "t1", F.lead("t0").over(w).alias("after"),
    )
    us = length.cast("bigint")
    placed = spans.select(
        *keys, "block", us.alias("slot_us"),
        F.when(F.col("before").isNull(), F.floor(F.col("t0") / us)).otherwise(F.floor(F.col("before") / us) + 1).cast("bigint").alias("from_slot"),
        F.floor(F.col("t1") / us).cast("bigint").alias("to_slot"),
    )
    # a long gap is cut too, so that no row has more than some blocks of slots to fill; only the last piece has the readings
    piece = slots_per_block * 4
    own_from = F.greatest(F.col("from_slot"), F.col("block") * slots_per_block)
    gap = F.when(
        own_from - F.col("from_slot") > piece,
        F.transform(F.sequence(F.col("from_slot"), own_from - 1, F.lit(piece).cast("bigint")), lambda s: F.struct(s.alias("from_slot"), F.least(s + piece - 1, own_from - 1).alias("to_slot"), F.lit(True).alias("empty"))),
    ).otherwise(F.array().cast("array<struct<from_slot:bigint,to_slot:bigint,empty:boolean>>"))
    start = F.when(own_from - F.col("from_slot") > piece, own_from).otherwise(F.col("from_slot"))
    pieces = placed.select(
        *keys, "block", "slot_us", F.explode(F.concat(gap, F.array(F.struct(start.alias("from_slot"), F.col("to_slot"), F.lit(False).alias("empty"))))).alias("p")
    ).select(*keys, "block", "slot_us", "p.*")
    ready = joined.join(pieces, [*keys, "block"]).join(scales, keys, "left")
    head = F.expr(f"slice(rs, 1, {CONTEXT})")
    nothing = F.expr("slice(rs, 1, 0)")
    return ready.select(
        *keys, "slot_us", "from_slot", "to_slot", "r_bin", "q_bin", "prev",
        F.when(F.col("empty"), nothing).otherwise(F.col("rs")).alias("rs"),
        F.when(F.col("empty"), head).otherwise(F.col("next")).alias("next"),
    ).mapInArrow(_regular, SCHEMA)
