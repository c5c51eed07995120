"""Packed point messages ↔ rows: fields are found by name, offset and step, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: datatype numbers of point fields
DATATYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}


def decode_points(messages: DataFrame, fields: dict[str, tuple[int, int]], step: int, data: str = "data", key: str = "frame_id", skip_nans: bool = False) -> DataFrame:
    """key, point_idx and one double per field: ``fields`` maps names to (offset, datatype). A buffer whose
    length is no multiple of ``step`` loses its incomplete last point; null buffers give no rows."""
    dtype = np.dtype({"names": list(fields), "formats": [DATATYPES[t] for _, t in fields.values()], "offsets": [o for o, _ in fields.values()], "itemsize": step})
    key_type = messages.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                buffer = batch.column("data")[row].as_py()
                if buffer is None:
                    continue
                x = np.frombuffer(buffer, dtype, count=len(buffer) // step)
                at = np.arange(len(x))
                if skip_nans:
                    ok = np.all([np.isfinite(x[n].astype(float)) for n in fields], axis=0)
                    x, at = x[ok], at[ok]
                name = pa.array([batch.column("key")[row].as_py()] * len(x), batch.schema.field("key").type)
                yield pa.RecordBatch.from_arrays([name, pa.array(at, pa.int64()), *[pa.array(x[n].astype(np.float64)) for n in fields]], ["key", "point_idx", *fields])

    ddl = f"key {key_type}, point_idx bigint, " + ", ".join(f"`{n}` double" for n in fields)
    return messages.select(F.col(key).alias("key"), F.col(data).alias("data")).mapInArrow(decode, ddl).withColumnRenamed("key", key)


SIZES = {1: 1, 2: 1, 3: 2, 4: 2, 5: 4, 6: 4, 7: 4, 8: 8}


def layout(fields: dict[str, int]) -> tuple[dict[str, tuple[int, int]], int]:
    """({name: (offset, datatype)}, step) of fields packed one after the other."""
    at, out = 0, {}
    for name, kind in fields.items():
        out[name] = (at, kind)
        at += SIZES[kind]
    return out, at


def encode_points(points: DataFrame, fields: dict[str, int], key: str = "frame_id", order: str = "point_idx", most: int = 100_000, rgb: bool = False) -> DataFrame:
    """key, part, width, point_step, data: points packed in order of ``order``, at most ``most`` numbers of it a message (a
    large cloud becomes several, so no task gets it whole). Nulls become NaN, or 0 in whole numbers. With ``rgb`` the columns
    r, g, b are packed to 0x00RRGGBB and written as the float32 of the same bits, under that name."""
    offsets, step = layout({**fields, **({"rgb": 7} if rgb else {})})
    dtype = np.dtype({"names": list(offsets), "formats": [DATATYPES[k] for _, k in offsets.values()], "offsets": [o for o, _ in offsets.values()], "itemsize": step})
    key_type = points.schema[key].dataType.simpleString()
    colours = ["r", "g", "b"] if rgb else []

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_order", "ascending")])
        out = np.zeros(len(table), dtype)
        for name in fields:
            x = table.column(name).to_numpy()
            if out.dtype[name].kind in "iu" and x.dtype.kind == "f":
                x = np.nan_to_num(x)
            out[name] = x
        if rgb:
            r, g, b = (table.column(c).to_numpy().astype(np.uint32) for c in colours)
            out["rgb"] = ((r << 16) | (g << 8) | b).view(np.float32)
        head = [table.column("_key").slice(0, 1), table.column("_part").slice(0, 1)]
        return pa.table([*head, pa.array([len(out)], pa.int32()), pa.array([step], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["_key", "part", "width", "point_step", "data"])

    rows = points.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.floor(F.col(order) / F.lit(most)).cast("bigint").alias("_part"), *fields, *colours)
    return rows.groupBy("_key", "_part").applyInArrow(pack, f"_key {key_type}, part bigint, width int, point_step int, data binary").withColumnRenamed("_key", key)


def gray(images: DataFrame, key: str, encoding: str, height: str, width: str, step: str, data: str) -> DataFrame:
    """key, gray (binary, height × width): raw rgb8, bgr8 and mono8 images; another encoding is an error."""
    key_type = images.schema[key].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                e = (r["e"] or "mono8").lower()
                if e not in ("rgb8", "bgr8", "mono8", "8uc1"):
                    raise ValueError(f"encoding {e!r} is not supported")
                c = 3 if e.endswith("b8") or e == "bgr8" else 1
                x = np.frombuffer(r["d"], np.uint8).reshape(r["h"], r["s"])[:, : r["w"] * c].reshape(r["h"], r["w"], c)
                if c == 3:
                    weight = np.array([0.299, 0.587, 0.114]) if e == "rgb8" else np.array([0.114, 0.587, 0.299])
                    out.append(np.rint(x @ weight).astype(np.uint8).tobytes())
                else:
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.binary())], ["k", "gray"])

    rows = images.select(F.col(key).alias("k"), F.col(encoding).alias("e"), F.col(height).alias("h"), F.col(width).alias("w"), F.col(step).alias("s"), F.col(data).alias("d"))
    return rows.mapInArrow(convert, f"k {key_type}, gray binary").withColumnRenamed("k", key)


def flatten_scans(scans: DataFrame, lengths: dict[str, int], default: int = 1248) -> DataFrame:
    """Old scan rows (sensor, packets array<struct<stamp_ns, data>>) → one row per packet, each cut to the length
    its sensor type uses."""
    p = scans.select("sensor", F.posexplode("packets").alias("seq", "p")).select("sensor", "seq", "p.stamp_ns", "p.data")
    size = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]), F.col("sensor")), F.lit(default))
    return p.withColumn("data", F.substring(F.col("data"), F.lit(1), size))
