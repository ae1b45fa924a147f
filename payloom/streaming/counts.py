"""Gram counts and alert matches over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from payloom.operators.grams import explode_grams
from payloom.operators.packets import alert_times
from payloom.operators.stores import ExactStore


def windowed_counts(packets: DataFrame, n: int, *, late: str = "10 seconds", window: str = "1 minute", ts: str = "ts", payload: str = "payload") -> DataFrame:
    """(window, n, g, cnt) of a stream; packets later than `late` behind the newest are left out."""
    grams = explode_grams(packets.withWatermark(ts, late), n, payload=payload, keep=(ts,))
    return grams.groupBy(F.window(ts, window), "n", "g").agg(F.count("*").alias("cnt"))


def running_counts(packets: DataFrame, n: int, payload: str = "payload") -> DataFrame:
    """(n, g, cnt) over all that has come, for output mode complete or update."""
    return explode_grams(packets, n, payload=payload).groupBy("n", "g").agg(F.count("*").alias("cnt"))


def stream_to_store(packets: DataFrame, path: str, checkpoint: str, low: int, high: int | None = None, payload: str = "payload") -> StreamingQuery:
    """Keeps a store at path that grows with the stream: each micro-batch writes its own part once, and load sums the parts."""

    def add(batch: DataFrame, epoch: int) -> None:
        counts = ExactStore.build(batch, low, high, payload).table
        counts.write.mode("overwrite").parquet(f"{path}/counters/batch={epoch}")

    return packets.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_stream_store(spark, path: str, low: int, high: int | None = None) -> ExactStore:
    table = spark.read.parquet(f"{path}/counters").groupBy("n", "g").agg(F.sum("cnt").alias("cnt"))
    return ExactStore(table, low, high or low)


def stream_alert_matches(packets: DataFrame, alerts: DataFrame, ts: str = "ts") -> DataFrame:
    """Packets of a stream that have an alert (a table) at their time or an hour off."""
    times = alert_times(alerts)
    return packets.join(times, packets[ts] == times["__ts"], "left_semi")
