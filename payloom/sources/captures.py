"""Packet captures as a Spark data source: format("pcap"), one partition per file (a capture has no marks to split at).

Options: path (folder, file, or a comma-separated list) or files (a list of names as JSON), mode PERMISSIVE (default: unreadable
files are skipped with a warning, a truncated record ends its file) or FAILFAST. Paths with a scheme are read by Spark instead.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import os
import struct
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of packets that are handed on at once.
BATCH = 16 << 20
SCHEMA = "file string, pkt_no bigint, ts timestamp, caplen int, len int, data binary"
#: First four bytes of a capture (fixed values): byte order and fractions of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}


def files_of(path: str) -> list[str]:
    """Regular files at or below each of the comma-separated paths; missing ones are left out with a warning."""
    out: list[str] = []
    for part in filter(None, path.split(",")):
        if os.path.isdir(part):
            out += sorted(os.path.join(d, f) for d, _, names in os.walk(part) for f in names if os.path.isfile(os.path.join(d, f)))
        elif os.path.isfile(part):
            out.append(part)
        else:
            warnings.warn(f"no such capture: {part}", stacklevel=2)
    return out


def read_records(path: str, strict: bool = False) -> Iterator[tuple[int, int, int, bytes]]:
    """(microseconds, caplen, len, data) of each packet in a capture file."""
    with open(path, "rb") as f:
        yield from records_of(f, path, strict)


def records_of(f: BinaryIO, name: str, strict: bool = False) -> Iterator[tuple[int, int, int, bytes]]:
    """As read_records, of an open file."""
    head = f.read(24)
    if len(head) < 24 or head[:4] not in MAGIC:
        if strict:
            raise ValueError(f"not a capture: {name}")
        warnings.warn(f"not a capture: {name}", stacklevel=2)
        return
    order, fraction = MAGIC[head[:4]]
    while record := f.read(16):
        data = b""
        if len(record) == 16:
            seconds, part, caplen, size = struct.unpack(f"{order}IIII", record)
            data = f.read(caplen)
        if len(record) < 16 or len(data) < caplen:
            if strict:
                raise ValueError(f"truncated capture: {name}")
            return
        yield seconds * 1_000_000 + part // fraction, caplen, size, data


@dataclass
class CaptureFile(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict = options.get("path", ""), options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.files = json.loads(options.get("files", "[]"))

    def partitions(self) -> list[CaptureFile]:
        return [CaptureFile(f) for f in self.files + files_of(self.path)] or [CaptureFile("")]

    def read(self, partition: CaptureFile) -> Iterator[tuple]:
        if not partition.path:
            return
        for n, (micros, caplen, size, data) in enumerate(read_records(partition.path, self.strict)):
            yield partition.path, n, dt.datetime.fromtimestamp(micros // 1_000_000, dt.timezone.utc) + dt.timedelta(microseconds=micros % 1_000_000), caplen, size, data


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options)


def read_captures(spark: SparkSession, path: str | list[str], mode: str = "PERMISSIVE") -> DataFrame:
    """Captures at path, or the files of a list."""
    if remote(path):
        return read_captures_anywhere(spark, path, mode)
    spark.dataSource.register(CaptureSource)
    reader = spark.read.format("pcap").option("mode", mode)
    return reader.load(path) if isinstance(path, str) else reader.option("files", json.dumps(path)).load()


def remote(path: str | list[str]) -> bool:
    """Whether a path names a store."""
    return any("://" in p for p in ([path] if isinstance(path, str) else path))


def read_captures_anywhere(spark: SparkSession, path: str | list[str], mode: str = "PERMISSIVE") -> DataFrame:
    """As read_captures, for any store that Spark reads: files come through the binaryFile source, one row each."""
    names = path.split(",") if isinstance(path, str) else path
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(names)
    return parse_captures(files.select(F.col("path").alias("file"), "content"), mode)


def parse_captures(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """(file, content) -> a row per packet; null contents have none. Rows leave a task in batches of BATCH bytes."""
    strict = mode.upper() == "FAILFAST"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file"], frame["content"], strict=True):
                rows, held = [], 0
                for n, record in enumerate(records_of(io.BytesIO(content), name, strict)):
                    rows.append((name, n, *record))
                    held += record[1] + 64
                    if held >= BATCH:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["file", "pkt_no", "ts", "caplen", "len", "data"])
        return out.assign(ts=pd.to_datetime(out["ts"].astype("int64"), unit="us", utc=True))

    return files.where("content IS NOT NULL").select("file", "content").mapInPandas(run, SCHEMA)


def first_times(spark: SparkSession, path: str) -> DataFrame:
    """(file, first_ts) of each capture: one record of each file is read, in tasks (the whole file where a store is named)."""
    if remote(path):
        return read_captures_anywhere(spark, path).where("pkt_no = 0").select("file", F.col("ts").alias("first_ts"))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(f, next((r[0] for r in read_records(f)), None)) for f in frame["file"]]
            rows = [(f, t) for f, t in found if t is not None]
            yield pd.DataFrame({"file": [f for f, _ in rows], "first_ts": pd.to_datetime([t for _, t in rows], unit="us", utc=True)})

    names = [(f,) for f in files_of(path)]
    return spark.createDataFrame(names, "file string").repartition(max(1, len(names) // 64)).mapInPandas(first, "file string, first_ts timestamp")


def write_capture(path: str, packets: list[tuple[int, bytes]]) -> None:
    """A capture of (microseconds, frame), for tests and samples."""
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for micros, data in packets:
            f.write(struct.pack("<IIII", micros // 1_000_000, micros % 1_000_000, len(data), len(data)) + data)
