"""Stateful operators over streams: clock restamping, frames from packets, latest-value pairing, debounce.

Each keeps a few numbers per key in Spark's state store; with ``keep_ms`` a key without
rows for so long is forgotten (a stream with such a time limit never ends by itself). Rows of a
micro-batch are handled in order of their stamp, by array operations; batch counterparts (windows and ``last_seen``) give the same
result on complete data.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _run(df: DataFrame, key: str, func, out: str, state: str, keep_ms: int | None) -> DataFrame:
    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        yield func(k, pd.concat(list(batches)), held)
        if keep_ms:
            held.setTimeoutDuration(keep_ms)

    limit = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(step, out, state, "append", limit)


def restamp(df: DataFrame, window_us: int = 5_000_000, shift_us: int = 0, keep_ms: int | None = None) -> DataFrame:
    """``df``: key, kind ('clock' or 'image'), host_us, stamp_us (clock rows), id. Out: key, id, stamp_us of
    images: host time less the smallest clock delay of the last ``window_us`` (of the last clock row where none is so recent), plus
    ``shift_us``. Images before the first clock row, and those that would get a negative stamp, are dropped."""

    def step(key: tuple, rows: pd.DataFrame, state: GroupState) -> pd.DataFrame:
        hosts, gaps = map(list, state.get) if state.exists else ([], [])
        rows = rows.sort_values(["host_us", "kind"])
        clock, image = rows[rows["kind"] == "clock"], rows[rows["kind"] == "image"]
        hosts = np.r_[np.array(hosts, np.int64), clock["host_us"].to_numpy(np.int64)]
        gaps = np.r_[np.array(gaps, np.int64), (clock["host_us"] - clock["stamp_us"]).to_numpy(np.int64)]
        order = np.argsort(hosts, kind="stable")
        hosts, gaps = hosts[order], gaps[order]
        at = image["host_us"].to_numpy(np.int64)
        hi = np.searchsorted(hosts, at, "right")
        seen = hi > 0
        hi, at, ids = hi[seen], at[seen], image["id"].to_numpy(np.int64)[seen]
        lo = np.minimum(np.searchsorted(hosts, at - window_us, "left"), hi - 1)
        least = np.minimum.reduceat(np.r_[gaps, 0], np.c_[lo, hi].ravel())[::2] if len(at) else np.zeros(0, np.int64)
        new = at - least + shift_us
        if len(hosts):
            cut = min(int(np.searchsorted(hosts, int(rows["host_us"].max()) - window_us, "left")), len(hosts) - 1)
            hosts, gaps = hosts[cut:], gaps[cut:]
        state.update((hosts.tolist(), gaps.tolist()))
        return pd.DataFrame({"key": [key[0]] * int((new >= 0).sum()), "id": ids[new >= 0], "stamp_us": new[new >= 0]})

    rows = df.select("key", "kind", "host_us", F.coalesce("stamp_us", F.lit(0)).alias("stamp_us"), "id")
    return _run(rows, "key", step, "key string, id bigint, stamp_us bigint", "hosts array<bigint>, gaps array<bigint>", keep_ms)


def frames(packets: DataFrame, wait_for_info: bool = True, keep_ms: int | None = None) -> DataFrame:
    """``packets``: sensor, seq, is_info, is_frame_begin. Out: sensor, seq, frame. Data packets are numbered by
    frame; those before the first frame begin (and before device information, if awaited) are dropped."""

    def step(key: tuple, rows: pd.DataFrame, state: GroupState) -> pd.DataFrame:
        informed, frame = state.get if state.exists else (not wait_for_info, -1)
        rows = rows.sort_values("seq")
        info = rows["is_info"].to_numpy(bool)
        known = np.maximum.accumulate(np.r_[bool(informed), info])
        data = ~info & known[1:]
        number = int(frame) + np.cumsum(rows["is_frame_begin"].to_numpy(bool) & data)
        state.update((bool(known[-1]), int(number[-1])))
        on = data & (number >= 0)
        return pd.DataFrame({"sensor": [key[0]] * int(on.sum()), "seq": rows["seq"].to_numpy()[on], "frame": number[on]})

    return _run(packets, "sensor", step, "sensor string, seq bigint, frame bigint", "informed boolean, frame bigint", keep_ms)


def latest_value(df: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """``df``: key, kind ('left' or 'right'), t, id. Out: key, left_id, right_id: each left row with the last right
    row at or before it (null before the first)."""

    def step(key: tuple, rows: pd.DataFrame, state: GroupState) -> pd.DataFrame:
        last: Any = state.get[0] if state.exists else None
        rows = rows.assign(side=rows["kind"].eq("left")).sort_values(["t", "side", "id"])
        seen = rows["id"].astype("Int64").where(~rows["side"]).ffill()
        if last is not None:
            seen = seen.fillna(int(last))
        state.update((None if pd.isna(seen.iloc[-1]) else int(seen.iloc[-1]),))
        left = rows["side"].to_numpy(bool)
        return pd.DataFrame({"key": [key[0]] * int(left.sum()), "left_id": rows["id"][left].astype("Int64"), "right_id": seen[left]})

    return _run(df, "key", step, "key string, left_id bigint, right_id bigint", "last bigint", keep_ms)


def debounce(df: DataFrame, gap_us: int = 500_000, keep_ms: int | None = None) -> DataFrame:
    """``df``: key, t, id. Keeps rows more than ``gap_us`` after the last kept one."""

    def step(key: tuple, rows: pd.DataFrame, state: GroupState) -> pd.DataFrame:
        rows = rows.sort_values(["t", "id"])
        t, ids, kept = rows["t"].to_numpy(np.int64), rows["id"].to_numpy(np.int64), []
        at = int(np.searchsorted(t, state.get[0] + gap_us, "right")) if state.exists else 0
        while at < len(t):  # from kept row to kept row
            kept.append(at)
            at = int(np.searchsorted(t, t[at] + gap_us, "right"))
        if kept:
            state.update((int(t[kept[-1]]),))
        return pd.DataFrame({"key": [key[0]] * len(kept), "t": t[kept], "id": ids[kept]})

    return _run(df, "key", step, "key string, t bigint, id bigint", "last bigint", keep_ms)


def converted_imu(df: DataFrame, factor: float = 9.80665) -> DataFrame:
    """Accelerations scaled, all other columns as they are: stateless, the same on streams and tables."""
    a = F.col("linear_acceleration")
    return df.withColumn("linear_acceleration", F.struct(*[(a[c] * factor).alias(c) for c in "xyz"]))


def fan_out(df: DataFrame, sinks: list, checkpoint: str):
    """Starts a query that hands each micro-batch to every sink (a function of batch and number) once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
