import os
import time

import pyarrow as pa
from pyspark.sql import functions as F

from payloom.llm import common as C


def test_slices_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in (10, 900, 5000, 1, 400, 400, 400)])], ["t"])
    got = list(C.slices([batch]))
    assert [t for b in got for t in b.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(b.num_rows == 1 or b.nbytes <= 1000 for b in got)


def test_cleaning_removes_what_was_stored(spark):
    C.clean(spark)
    path = C.stored(spark.range(10), "some").inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    C.clean(spark)
    assert not os.path.exists(os.path.dirname(path))


def test_discarded_tables_and_ended_shuffles_leave_no_files(spark):
    files = lambda: [f for f in map(str, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f]
    before, usual = set(files()), spark.conf.get(C.SHUFFLE_CLEANUP)
    made = C.stored(spark.range(100_000).repartition(7), "some")
    deadline = time.time() + 20  # files go a moment after the write
    while set(files()) - before and time.time() < deadline:
        time.sleep(0.1)
    assert not set(files()) - before
    assert spark.conf.get(C.SHUFFLE_CLEANUP) == usual
    assert made.count() == 100_000
    folder = os.path.dirname(made.inputFiles()[0].removeprefix("file:"))
    C.discard(made)
    assert not os.path.exists(folder)


def test_tables_of_workers_are_whole(spark):
    """Equal to what Spark writes; files of attempts that didn't end aren't read; other types take Spark's writer."""
    rows = [(None, None, None, None), (1, b"\xff\x00", ["a", None, "é"], (True, None)), (2, b"", [], (None, 1 << 40)), (2, b"", [], (None, 1 << 40))]
    df = spark.createDataFrame(rows, "a int, b binary, c array<string>, d struct<x: boolean, y: long>").repartition(7)
    made = C.stored_by_workers(df, "some")
    assert made.schema == df.schema and sorted(made.collect(), key=str) == sorted(df.collect(), key=str)
    folder = os.path.dirname(made.inputFiles()[0].removeprefix("file:"))
    with open(f"{folder}/_part-of-another-attempt.zstd.parquet", "wb") as left:
        left.write(b"PAR1 half a file")
    assert spark.read.schema(df.schema).parquet(folder).count() == 4
    C.discard(made)
    assert not os.path.exists(folder)
    none = C.stored_by_workers(df.where("a > 5"), "none")
    assert none.schema == df.schema and none.count() == 0
    many = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    assert C.stored_by_workers(many.repartition(1), "many").exceptAll(many).count() == 0
    other = spark.range(5).select(F.col("id").cast("decimal(20,3)").alias("n"), F.current_timestamp().alias("at"))
    assert C.stored_by_workers(other, "other").dtypes == other.dtypes


def test_ended_shuffles_of_workers_tables_leave_no_files(spark):
    files = lambda: {f for f in map(str, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before = files()
    made = C.stored_by_workers(spark.range(100_000).repartition(7), "some")
    deadline = time.time() + 20  # files go a moment after the write
    while files() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files() - before and made.count() == 100_000
