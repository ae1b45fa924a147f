"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes (but for a single row of more), that a Python operator turns into Python objects at once.
SLICE_ROWS = 256
SLICE_BYTES = 64 << 20
#: What Spark puts into one Arrow batch for a Python worker, set for the session where it has no setting of its own: its
#: usual 10,000 long texts a batch take most of a small executor's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(16 << 20))}

#: Spark keeps the shuffle files of an ended write until the driver collects its garbage, which doesn't come sooner for larger files;
#: with this they go when the write ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes that a worker gathers for a row group, and the types that it writes as Spark does.
ROW_GROUP = 8 << 20
PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.IntegerType, T.LongType)

_MADE: dict[str, list[str]] = {}
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def bound_batches(spark: SparkSession) -> None:
    for key, (usual, value) in BATCH.items():
        if spark.conf.get(key, usual) in (usual, str(256 << 20), str((1 << 31) - 1), "-1"):
            spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (where unset, as in tests) a new temp folder.

    Without a local master there must be such a folder: executors don't share the driver's temp folder.
    """
    bound_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        root = sc.getCheckpointDir()
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not root:
            root = tempfile.mkdtemp(prefix="payloom-")
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; clean() removes it."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    release()  # of the driver, where many steps run one after another


def _read(df: DataFrame, path: str) -> DataFrame:
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[made] = path
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors cost no recomputation.

    The shuffle files of the write go with its end; discard() removes the table itself.
    """
    path = shared_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return _read(df, path)


def stored_by_workers(df: DataFrame, name: str) -> DataFrame:
    """stored(), for the many tables of a long operator: on a local disk the Python workers write the files.

    Spark's writer there starts three child processes for each file (chmod of the folder, the file and its checksum). Each shares all
    memory of the executor's JVM until it runs, so that it counts twice. Files of ended tasks only are given their names, by the
    driver; what other attempts leave is hidden and goes with the table. Other folders and types take Spark's writer.
    """
    spark = df.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file" or not _plain(df.schema):
        return stored(df, name)
    path = shared_path(spark, name)
    folder = f"{files.makeQualified(root).toUri().getPath()}/{path.rpartition('/')[2]}"
    os.makedirs(folder)
    with _shuffles_removed(spark):
        ended = df.mapInArrow(_parts(folder), "part string").collect()
    for row in ended:
        os.rename(f"{folder}/_{row['part']}", f"{folder}/{row['part']}")
    return _read(df, path)


def _plain(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return _plain(kind.elementType) if isinstance(kind, T.ArrayType) else type(kind) in PLAIN


def _parts(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the rows of a task as one hidden file of the folder, if there are any, and gives its later name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.parquet import ParquetWriter

        name, out, held, size = f"part-{uuid.uuid4().hex}.zstd.parquet", None, [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if held and (batch is None or size >= ROW_GROUP):
                out = out or ParquetWriter(f"{folder}/_{name}", held[0].schema, compression="zstd")
                out.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["part"])
        release()

    return run


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that stored() or stored_by_workers() has returned; all that reads them must have been written."""
    for df in tables:
        path = _STORED.pop(df)
        _remove(df.sparkSession, path)
        made = _MADE.get(df.sparkSession.sparkContext.applicationId, [])
        if path in made:
            made.remove(path)


def clean(spark: SparkSession) -> None:
    """Removes what stored() and shared_path() have made in this session; their readers must have ended."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        _remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(col: Column) -> Column:
    """The bytes of a string column; null stays null."""
    return col.cast("string").cast("binary")


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and few bytes, so that few long texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _halved(batch.slice(at, rows))
    release()


def release() -> None:
    """Gives memory that a task has freed back to the system, as worker processes live on."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def _halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and batch.nbytes > SLICE_BYTES:
        half = batch.num_rows // 2
        yield from _halved(batch.slice(0, half))
        yield from _halved(batch.slice(half))
    else:
        yield batch


#: Bytes of a lower-cased word or 32: A-Z become a-z; a-z, 0-9 and bytes from 0x80 stay.
ALNUM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A-Z become a-z, the rest stays; bytes.split() then parts at 0x20 and 0x09-0x0D, as its words want.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Bits of a filter that picks rows by a long; a false hit only costs time.
FILTER_BITS = 1 << 26


@dataclass
class Bits:
    """A set of longs as a bit filter of fixed size: has never misses a member."""

    bits: np.ndarray

    def has(self, values: np.ndarray) -> np.ndarray:
        place = values % FILTER_BITS
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def bit_filter(df: DataFrame, col: str) -> Bits:
    """The filter of a column of longs; what reaches the driver is FILTER_BITS / 8 bytes at most, at any size."""
    at = F.pmod(F.col(col), F.lit(FILTER_BITS)) + 1
    filled = df.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in filled.toLocalIterator():
        bits[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return Bits(bits)


def partitions_for(df: DataFrame, mb: int = 32) -> int:
    """Partitions of about mb MB of the plan's estimated input, spark.sql.shuffle.partitions at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size // (mb << 20), 1_000_000))
