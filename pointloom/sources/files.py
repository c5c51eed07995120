"""Python data sources for folders of this machine: ``pcd`` (read and write), ``rosbag2`` and ``pcap``; ``register`` makes them
formats. ``read_clouds``, ``read_captures``, ``read_arrays`` and ``read_pixels`` go through Spark's own file system, so they read from
any store it knows, in Arrow batches.
"""

from __future__ import annotations

import glob
import io
import os
import re
import sqlite3
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class _File(InputPartition):
    def __init__(self, path: str, lo: int = 0, hi: int = 0):
        self.path, self.lo, self.hi = path, lo, hi


def _files(path: str, suffix: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(path, "**", f"*{suffix}"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(f"no {suffix} files at {path}")
    return found


def read_pcd(data: bytes) -> tuple[list[str], np.ndarray]:
    """Field names and rows (double) of a point file with binary or ASCII body."""
    end = re.search(rb"^DATA[^\n]*\n", data, re.M)
    if not end:
        raise ValueError("no DATA line")
    head = {m[0]: m[1:] for m in (line.split() for line in data[: end.end()].decode().splitlines()) if m and m[0] != "#"}
    names, n = head["FIELDS"], int(head["POINTS"][0])
    kinds = [{"F": "<f", "I": "<i", "U": "<u"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    if head["DATA"] == ["ascii"]:
        rows = np.array([line.split() for line in data[end.end() :].decode().split("\n")[:n]], dtype=float).reshape(n, len(names))
        return names, rows
    x = np.frombuffer(data, np.dtype(list(zip(names, kinds, strict=True))), count=n, offset=end.end())
    return names, np.stack([x[f].astype(float) for f in names], axis=1) if n else np.zeros((0, len(names)))


def pcd_bytes(xyzi: np.ndarray) -> bytes:
    """A binary point file of float32 x, y, z and, with four columns, intensity; rows with NaN are left out."""
    x = xyzi[~np.isnan(xyzi[:, :3]).any(axis=1)].astype("<f4")
    names = "x y z intensity".split()[: x.shape[1]]
    k = len(names)
    head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(names), "SIZE" + " 4" * k, "TYPE" + " F" * k, "COUNT" + " 1" * k, f"WIDTH {len(x)}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(x)}", "DATA binary"]
    return ("\n".join(head) + "\n").encode() + x.tobytes()


class PcdSource(DataSource):
    """``path`` is a file, pattern or folder; one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return "file string, point_idx bigint, x double, y double, z double, intensity double"

    def reader(self, schema) -> DataSourceReader:
        return _PcdReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PcdWriter(self.options["path"], [f.name for f in schema.fields])


class _PcdReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path, ".pcd")]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            names, rows = read_pcd(f.read())
        at = {n: k for k, n in enumerate(names)}
        name = os.path.basename(partition.path)
        for i, r in enumerate(rows.tolist()):
            yield (name, i, r[at["x"]], r[at["y"]], r[at["z"]], r[at["intensity"]] if "intensity" in at else None)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    points: int


class _PcdWriter(DataSourceWriter):
    """One file per task; a task's file gets its final name only when the task is done."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def write(self, iterator) -> WriterCommitMessage:
        use = [c for c in ("x", "y", "z", "intensity") if c in self.columns]
        rows = [[float("nan") if r[c] is None else r[c] for c in use] for r in iterator]
        os.makedirs(self.path, exist_ok=True)
        final = os.path.join(self.path, f"part-{uuid.uuid4().hex}.pcd")
        with open(final + ".tmp", "wb") as f:
            f.write(pcd_bytes(np.array(rows, dtype=float).reshape(-1, len(use))))
        os.replace(final + ".tmp", final)
        return _Written(final, len(rows))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class BagSource(DataSource):
    """rosbag2 folders with sqlite storage: topic, t_ns, data. Option ``topic`` reads one topic only;
    ``rows`` is the number of messages per partition."""

    @classmethod
    def name(cls) -> str:
        return "rosbag2"

    def schema(self) -> str:
        return "topic string, t_ns bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _BagReader(self.options["path"], self.options.get("topic"), int(self.options.get("rows", 50_000)))


class _BagReader(DataSourceReader):
    def __init__(self, path: str, topic: str | None, rows: int):
        self.path, self.topic, self.rows = path, topic, rows

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in _files(self.path, ".db3"):
            with sqlite3.connect(f"file:{p}?mode=ro", uri=True) as con:
                lo, hi = con.execute("SELECT min(id), max(id) FROM messages").fetchone()
            if lo is not None:
                out += [_File(p, a, min(a + self.rows - 1, hi)) for a in range(lo, hi + 1, self.rows)]
        return out or [_File("", 1, 0)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            sql = "SELECT t.name, m.timestamp, m.data FROM messages m JOIN topics t ON m.topic_id = t.id WHERE m.id BETWEEN ? AND ?"
            with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as con:
                yield from con.execute(sql + (" AND t.name = ?" if self.topic else ""), (partition.lo, partition.hi, *([self.topic] if self.topic else [])))


def pcap_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(nanoseconds, frame) of a capture file, either byte order, micro- or nanosecond stamps."""
    order = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}.get(data[:4])
    if order is None:
        raise ValueError("not a capture file")
    at, (end, unit) = 24, order
    while at + 16 <= len(data):
        sec, sub, size, _ = struct.unpack_from(end + "IIII", data, at)
        if at + 16 + size > len(data):
            return  # cut off while it was written
        yield sec * 1_000_000_000 + sub * unit, data[at + 16 : at + 16 + size]
        at += 16 + size


def udp_payload(frame: bytes) -> tuple[int, bytes] | None:
    """(destination port, payload) of an Ethernet frame with IPv4 and UDP, with or without a VLAN tag."""
    at = 18 if frame[12:14] == b"\x81\x00" else 14
    if frame[at - 2 : at] != b"\x08\x00" or len(frame) < at + 28 or frame[at + 9] != 17:
        return None
    ip = at + (frame[at] & 15) * 4
    return struct.unpack_from(">H", frame, ip + 2)[0], frame[ip + 8 : ip + struct.unpack_from(">H", frame, ip + 4)[0]]


class PcapSource(DataSource):
    """Capture files: file, t_ns, port, data (UDP payload; ``head`` and ``tail`` bytes are cut off). Option
    ``port`` keeps one destination port."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return "file string, t_ns bigint, port int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _PcapReader(self.options["path"], self.options.get("port"), int(self.options.get("head", 0)), int(self.options.get("tail", 0)))


class _PcapReader(DataSourceReader):
    def __init__(self, path: str, port: str | None, head: int, tail: int):
        self.path, self.port, self.head, self.tail = path, port and int(port), head, tail

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path, ".pcap")]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        for t, frame in pcap_records(data):
            got = udp_payload(frame)
            if got and self.port in (None, got[0]):
                yield os.path.basename(partition.path), t, got[0], got[1][self.head : len(got[1]) - self.tail]


def register(spark: SparkSession) -> None:
    for source in (PcdSource, BagSource, PcapSource):
        spark.dataSource.register(source)


def _contents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parsed(raw: DataFrame, parse: Callable[[str, bytes], list], schema: pa.Schema, ddl: str) -> DataFrame:
    """``parse`` (file name, content) → columns; a file is one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                columns = parse(os.path.basename(path), content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return raw.mapInArrow(run, ddl)


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    """file, point_idx, x, y, z, intensity (null where a file has none) of all point files under ``path``."""
    schema = pa.schema([("file", pa.string()), ("point_idx", pa.int64()), *[(c, pa.float64()) for c in ("x", "y", "z", "intensity")]])

    def parse(name: str, content: bytes) -> list:
        fields, rows = read_pcd(content)
        column = lambda c: rows[:, fields.index(c)] if c in fields else [None] * len(rows)
        return [[name] * len(rows), np.arange(len(rows)), *map(column, ("x", "y", "z", "intensity"))]

    return _parsed(_contents(spark, path, "*.pcd"), parse, schema, "file string, point_idx bigint, x double, y double, z double, intensity double")


def read_captures(spark: SparkSession, path: str, port: int | None = None, head: int = 0, tail: int = 0) -> DataFrame:
    """file, t_ns, port, data of all capture files under ``path``; see the ``pcap`` format."""
    schema = pa.schema([("file", pa.string()), ("t_ns", pa.int64()), ("port", pa.int32()), ("data", pa.binary())])

    def parse(name: str, content: bytes) -> list:
        got = [(t, udp_payload(frame)) for t, frame in pcap_records(content)]
        rows = [(name, t, p[0], p[1][head : len(p[1]) - tail]) for t, p in got if p and port in (None, p[0])]
        return list(zip(*rows, strict=True)) or [[]] * 4

    return _parsed(_contents(spark, path, "*.pcap"), parse, schema, "file string, t_ns bigint, port int, data binary")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, name, shape, values (doubles by rows; null for text), texts (null for numbers) of all .npz and .npy files under ``path``.
    Arrays of objects are not read."""
    schema = pa.schema([("file", pa.string()), ("name", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("texts", pa.list_(pa.string()))])

    def parse(file: str, content: bytes) -> list:
        got = np.load(io.BytesIO(content), allow_pickle=False)
        rows = []
        for name, x in [("", got)] if isinstance(got, np.ndarray) else got.items():
            text = x.dtype.kind in "US"
            rows.append((file, name, list(x.shape), None if text else x.astype(float).ravel(), x.astype(str).ravel().tolist() if text else None))
        return list(zip(*rows, strict=True)) or [[]] * 5

    return _parsed(_contents(spark, path, "*.np[yz]"), parse, schema, "file string, name string, shape array<bigint>, values array<double>, texts array<string>")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """file, u, v, r, g, b of all images Spark's image source can decode; a gray image has equal parts."""
    images = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    schema = pa.schema([("file", pa.string()), *[(c, pa.int32()) for c in ("u", "v", "r", "g", "b")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, w, c = r["height"], r["width"], r["nChannels"]
                x = np.frombuffer(r["data"], np.uint8).reshape(h, w, c)
                blue, green, red = (x[..., k if c >= 3 else 0].ravel() for k in range(3))
                v, u = np.divmod(np.arange(h * w), w)
                yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(r["origin"])] * (h * w)), *[pa.array(a.astype(np.int32)) for a in (u, v, red, green, blue)]], schema=schema)

    return images.mapInArrow(run, "file string, u int, v int, r int, g int, b int")


def save_pairs(clouds: DataFrame, images: DataFrame, path: str, capture: str = "capture_idx") -> None:
    """Captures as folders ``capture_idx=…`` under path/clouds and path/images; only captures that have both are kept."""
    both = clouds.select(capture).distinct().intersect(images.select(capture))
    for name, df in (("clouds", clouds), ("images", images)):
        df.join(both, capture, "left_semi").repartition(capture).write.mode("append").partitionBy(capture).parquet(os.path.join(path, name))


def paired_files(spark: SparkSession, folder: str, first: str = "_image.png", second: str = "_lidar.pcd"):
    """stem, first path, second path of the files that come in pairs, in order of their stem."""
    from pyspark.sql import functions as F

    def side(suffix: str, name: str):
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
        return files.select(F.regexp_extract("path", rf"([^/]+){re.escape(suffix)}$", 1).alias("stem"), F.col("path").alias(name))

    return side(first, "first").join(side(second, "second"), "stem").orderBy("stem")
