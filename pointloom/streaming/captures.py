"""Packets as a stream: capture files that arrive in a folder, a bounded number per micro-batch."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointloom.sources.files import pcap_records, udp_payload


def packet_stream(spark: SparkSession, folder: str, port: int | None = None, head: int = 0, tail: int = 0, files_per_trigger: int = 1) -> DataFrame:
    """Streaming file, t_ns, port, data: the columns of the ``pcap`` format for files as they arrive. A recorder that
    closes a file every few seconds makes this a live source; ``files_per_trigger`` sets the rate of a replay.
    ``port`` keeps one destination port, ``head`` and ``tail`` bytes of every payload are cut off."""
    raw = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.pcap").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for t, frame in pcap_records(content.as_py()):
                    got = udp_payload(frame)
                    if got and port in (None, got[0]):
                        rows.append((os.path.basename(path), t, got[0], got[1][head : len(got[1]) - tail]))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "t_ns", "port", "data"])

    return raw.select("path", "content").mapInArrow(parse, "file string, t_ns bigint, port int, data binary")
