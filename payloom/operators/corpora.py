"""Comparing corpora with a store, and Markov chains over one."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payloom.operators.grams import gram_counts
from payloom.operators.stores import GramStore

BINS = 1024
#: Grams of a transition table that a walk may hold in each task.
WALK_GRAMS = 4_000_000


def membership(df: DataFrame, store: GramStore, payload: str = "payload") -> DataFrame:
    """(n, g, weight, found): the grams of a corpus, how often they occur, and their count in a store.

    Grams are counted first, so that a gram is looked up once however often it occurs.
    """
    counts = gram_counts(df, store.low, store.high, payload=payload)
    return counts.withColumnRenamed("cnt", "weight").join(store.find(counts.select("n", "g")), ["n", "g"])


def compare(df: DataFrame, store: GramStore, payload: str = "payload") -> DataFrame:
    """n, found, not_found, total, fraction: of a corpus's grams, repeats counted, those that a store has."""
    rows = membership(df, store, payload)
    hit = F.sum(F.when(F.col("found") > 0, F.col("weight")).otherwise(0))
    total = F.sum("weight")
    return rows.groupBy("n").agg(hit.alias("found"), (total - hit).alias("not_found"), total.alias("total"), (hit / total).alias("fraction"))


def compare_histogram(df: DataFrame, store: GramStore, payload: str = "payload") -> DataFrame:
    """n, bin, weight: BINS bins of equal width up to the largest counter."""
    width = store.table.groupBy("n").agg(F.greatest(F.lit(1), F.ceil(F.least(F.max("cnt"), F.lit(65520)) / BINS)).alias("width"))
    rows = membership(df, store, payload).join(F.broadcast(width), "n")
    return rows.groupBy("n", F.least(F.floor(F.col("found") / F.col("width")), F.lit(BINS - 1)).alias("bin")).agg(F.sum("weight").alias("weight"))


def transitions(counts: DataFrame) -> DataFrame:
    """(prefix, byte, cnt, total, cumulative): the bytes that follow each prefix, with running sums in order of byte."""
    rows = counts.select(F.col("g").substr(F.lit(1), F.length("g") - 1).alias("prefix"), F.conv(F.hex(F.col("g").substr(F.length("g"), F.lit(1))), 16, 10).cast("int").alias("byte"), "cnt")
    w = Window.partitionBy("prefix")
    return rows.select("prefix", "byte", "cnt", F.sum("cnt").over(w).alias("total"), F.sum("cnt").over(w.orderBy("byte").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def cumulative_codes(counts: DataFrame) -> DataFrame:
    """transitions with the 16-bit code floor(cumulative * 65536 / total) - 1, never below 0."""
    return transitions(counts).withColumn("code", F.greatest(F.lit(0), F.floor(F.col("cumulative") * 65536 / F.col("total")) - 1))


def next_bytes(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(prefix, target 0..65535) -> the first byte whose code reaches the target, else the last byte; null at a dead end."""
    rows = targets.join(cumulative_codes(counts).select("prefix", "byte", "code"), "prefix", "left")
    reached = F.min(F.when(F.col("code") >= F.col("target"), F.col("byte")))
    return rows.groupBy("prefix", "target").agg(F.coalesce(reached, F.max("byte")).alias("next"))


def walk(counts: DataFrame, n: int, length: int, walks: int = 1, seed: int = 0, start: bytes | None = None) -> DataFrame:
    """(walk, text): random texts of a length in bytes whose grams all occur, each from a seed of its own.

    Every walk is a group of its own; it begins with start or with a prefix that is printable throughout, if there is one. A dead end goes back two bytes, further on repeated failure. The table of grams
    must be small enough to be held by a task (WALK_GRAMS).
    """
    spark = counts.sparkSession
    rows = counts.limit(WALK_GRAMS + 1).collect()
    if len(rows) > WALK_GRAMS:
        raise ValueError(f"more than {WALK_GRAMS} grams: thin the store out before a walk")
    table: dict[bytes, list[tuple[int, int]]] = {}
    for r in sorted(rows, key=lambda r: bytes(r["g"])):
        g = bytes(r["g"])
        total = table.setdefault(g[:-1], [])
        total.append((g[-1], r["cnt"] + (total[-1][1] if total else 0)))
    printable = sorted(p for p in table if p and all(0x20 <= b <= 0x7E for b in p))
    shared = spark.sparkContext.broadcast((table, printable or sorted(table)))

    def generate(frames):
        import pandas as pd

        chain, starts = shared.value
        for frame in frames:
            out = []
            for w in frame["id"]:
                rng = random.Random(seed * 1_000_003 + int(w))
                text, failures = bytearray(start or (rng.choice(starts) if starts else b"")), 0
                while starts and len(text) < length and failures < 10_000:
                    follow = chain.get(bytes(text[len(text) - n + 1 :]))
                    if follow is None:
                        failures += 1
                        del text[max(n - 1, len(text) - 2 - failures) :]
                        if len(text) <= n - 1:
                            text = bytearray(rng.choice(starts))
                        continue
                    target = rng.randrange(follow[-1][1])
                    text.append(next(b for b, c in follow if c > target))
                out.append(bytes(text[:length]))
            yield pd.DataFrame({"walk": frame["id"], "text": out})

    return spark.range(walks).mapInPandas(generate, "walk long, text binary")
