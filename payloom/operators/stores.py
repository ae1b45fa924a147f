"""Gram stores: exact counts and counting Bloom filters as tables.

A store is a table of non-zero counters, (n, g, cnt) or (n, spot, cnt), beside a label row per n. Counters add up, so stores
are built by partial aggregation and merged by union and sum; 16-bit saturation is applied when counters are read.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom.functions.hashing import fnv64_halves, spots
from payloom.operators.grams import COUNTER_MAX, explode_grams, gram_counts
from payloom.operators.statistics import slot_stats

#: Expected distinct grams of 1, 2 and 3 bytes (fixed values).
ENTRIES = {1: 600, 2: 100_000, 3: 20_000_000}


def bloom_entries(n: int) -> int:
    """Expected distinct grams of n bytes; from four bytes on 2^(n/4 + 23)."""
    return ENTRIES.get(n) or int(2 ** (n / 4 + 23))


@dataclass(frozen=True)
class BloomSize:
    """per_entry counters for each expected gram, k hashes."""

    per_entry: int = 32
    k: int = 23

    def m(self, n: int) -> int:
        return bloom_entries(n) * self.per_entry


LARGE, SMALL = BloomSize(), BloomSize(20, 14)


@dataclass(frozen=True)
class GramStore(ABC):
    """Counters of grams of low..high bytes."""

    table: DataFrame
    low: int
    high: int

    @property
    @abstractmethod
    def address(self) -> str:
        """The column that tells counters apart."""

    @abstractmethod
    def _with(self, table: DataFrame) -> GramStore: ...

    @abstractmethod
    def _counters(self, counts: DataFrame) -> DataFrame:
        """(n, g, cnt) -> (n, address, cnt)."""

    def _deletable(self, counts: DataFrame) -> DataFrame:
        """Of the grams to be taken away those that may be."""
        return counts

    @abstractmethod
    def find(self, grams: DataFrame) -> DataFrame:
        """(n, g) distinct -> (n, g, found)."""

    @abstractmethod
    def size(self, n: int) -> int:
        """How many counters there are for n."""

    def _sum(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("n", self.address).agg(F.sum("cnt").alias("cnt")).where("cnt > 0")

    def add(self, df: DataFrame, payload: str = "payload") -> GramStore:
        return self._with(self._sum(self.table.unionByName(self._counters(gram_counts(df, self.low, self.high, payload=payload)))))

    def delete(self, df: DataFrame, payload: str = "payload") -> GramStore:
        """Takes grams away; counters stop at zero and those that are saturated stay.

        A filter first looks every gram up and leaves those alone that it has fewer of: their counters belong to others.
        """
        gone = self._counters(self._deletable(gram_counts(df, self.low, self.high, payload=payload))).withColumn("cnt", -F.col("cnt"))
        kept = self.table.withColumn("full", F.col("cnt") >= COUNTER_MAX).unionByName(gone.withColumn("full", F.lit(False)))
        summed = kept.groupBy("n", self.address).agg(F.when(F.max("full"), F.lit(COUNTER_MAX)).otherwise(F.sum("cnt")).cast("long").alias("cnt"))
        return self._with(summed.where("cnt > 0"))

    def merge(self, other: GramStore) -> GramStore:
        if (self.low, self.high, self.address) != (other.low, other.high, other.address):
            raise ValueError("only stores of one kind and range can be merged")
        return self._with(self._sum(self.table.unionByName(other.table)))

    @property
    def _per_gram(self) -> int:
        """How many counters a gram adds to."""
        return 1

    def _overflow(self) -> Column:
        return F.greatest(F.col("cnt") - COUNTER_MAX + (1 if self.address == "spot" else 0), F.lit(0))

    def counters(self) -> DataFrame:
        """n, address, counter (16 bits), overflow."""
        return self.table.select("n", self.address, F.least("cnt", F.lit(COUNTER_MAX)).alias("counter"), self._overflow().alias("overflow"))

    def stats(self) -> DataFrame:
        """n, mu, sigma, max, min, chi_square over all counters, zeros too."""
        m = F.coalesce(*[F.when(F.col("n") == n, F.lit(float(self.size(n)))) for n in range(self.low, self.high + 1)])
        return slot_stats(self.table, m)

    def label(self) -> DataFrame:
        """A row per n: kind, m, total (of grams), distinct counters, overflow."""
        over = F.sum(self._overflow())
        rows = self.table.groupBy("n").agg((F.sum("cnt") / self._per_gram).cast("long").alias("total"), F.count("*").alias("distinct_counters"), over.alias("overflow"))
        return rows.select("n", F.lit(type(self).__name__).alias("kind"), F.coalesce(*[F.when(F.col("n") == n, F.lit(self.size(n))) for n in range(self.low, self.high + 1)]).cast("long").alias("m"), "total", "distinct_counters", "overflow")

    def probe(self, df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
        """keep..., n, pos, found for each gram of each payload; limit: only the first positions."""
        rows = explode_grams(df, self.low, self.high, payload=payload, keep=keep)
        if limit is not None:
            rows = rows.where(F.col("pos") < limit)
        found = self.find(rows.select("n", "g").distinct())
        return rows.join(found, ["n", "g"], "left").select(*keep, "n", "pos", F.coalesce("found", F.lit(0)).alias("found"))

    def totals(self, df: DataFrame, keep: tuple[str, ...], payload: str = "payload") -> DataFrame:
        """keep..., n, total: the sum of the counts of each row's grams."""
        return self.probe(df, payload, keep).groupBy(*keep, "n").agg(F.sum("found").alias("total"))

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Counters and label as Parquet, counters by n. mode append adds to what is there: counters are summed when loaded, and the label is of them all."""
        self.table.repartition("n", self.address).write.mode(mode).partitionBy("n").parquet(f"{path}/counters")
        whole = self._loaded(self.table.sparkSession, path) if mode == "append" else self
        whole.label().coalesce(1).write.mode("overwrite").parquet(f"{path}/label")

    def _loaded(self, spark: SparkSession, path: str) -> GramStore:
        return self._with(self._sum(spark.read.parquet(f"{path}/counters").select(F.col("n").cast("int"), self.address, "cnt")))

    def dump(self) -> DataFrame:
        """Non-zero counters in order."""
        return self.counters().select("n", self.address, "counter").orderBy("n", self.address)


@dataclass(frozen=True)
class ExactStore(GramStore):
    @property
    def address(self) -> str:
        return "g"

    def _with(self, table: DataFrame) -> ExactStore:
        return ExactStore(table, self.low, self.high)

    def _counters(self, counts: DataFrame) -> DataFrame:
        return counts

    def find(self, grams: DataFrame) -> DataFrame:
        return grams.join(self.table, ["n", "g"], "left").select("n", "g", F.least(F.coalesce("cnt", F.lit(0)), F.lit(COUNTER_MAX)).alias("found"))

    def size(self, n: int) -> int:
        return 256**n if n < 8 else (1 << 63) - 1

    @staticmethod
    def build(df: DataFrame, low: int, high: int | None = None, payload: str = "payload") -> ExactStore:
        return ExactStore(gram_counts(df, low, high, payload=payload), low, high or low)

    @staticmethod
    def load(spark: SparkSession, path: str, low: int, high: int) -> GramStore:
        return ExactStore(spark.createDataFrame([], "n int, g binary, cnt long"), low, high)._loaded(spark, path)


@dataclass(frozen=True)
class BloomStore(GramStore):
    """A counting Bloom filter of k hashes; m_of gives the counters for n where it isn't the standard size."""

    k: int = LARGE.k
    per_entry: int = LARGE.per_entry
    m_of: dict = field(default_factory=dict)

    @property
    def address(self) -> str:
        return "spot"

    def _with(self, table: DataFrame) -> BloomStore:
        return BloomStore(table, self.low, self.high, self.k, self.per_entry, self.m_of)

    def size(self, n: int) -> int:
        return self.m_of.get(n) or BloomSize(self.per_entry, self.k).m(n)

    def _spots(self, grams: DataFrame) -> DataFrame:
        """Adds spots to rows with n and g: hashes are made once for each distinct gram."""
        hashed = grams.withColumn("h", fnv64_halves(F.col("g")))
        one = lambda n: F.when(F.col("n") == n, spots(F.col("h"), self.k, self.size(n)))
        return hashed.withColumn("spot", F.explode(F.coalesce(*map(one, range(self.low, self.high + 1))))).drop("h")

    @property
    def _per_gram(self) -> int:
        return self.k

    def _deletable(self, counts: DataFrame) -> DataFrame:
        found = self.find(counts.select("n", "g"))
        return counts.join(found, ["n", "g"]).where("found >= cnt").drop("found")

    def _counters(self, counts: DataFrame) -> DataFrame:
        return self._sum(self._spots(counts).select("n", "spot", "cnt"))

    def find(self, grams: DataFrame) -> DataFrame:
        rows = self._spots(grams).join(self.table, ["n", "spot"], "left")
        return rows.groupBy("n", "g").agg(F.least(F.min(F.coalesce("cnt", F.lit(0))), F.lit(COUNTER_MAX)).alias("found"))

    @staticmethod
    def build(df: DataFrame, low: int, high: int | None = None, payload: str = "payload", **size) -> BloomStore:
        empty = df.sparkSession.createDataFrame([], "n int, spot long, cnt long")
        store = BloomStore(empty, low, high or low, **size)
        return store._with(store._counters(gram_counts(df, low, high, payload=payload)))

    @staticmethod
    def load(spark: SparkSession, path: str, low: int, high: int, **size) -> GramStore:
        return BloomStore(spark.createDataFrame([], "n int, spot long, cnt long"), low, high, **size)._loaded(spark, path)


def bloom_distinct(grams: DataFrame, store: BloomStore, order: str = "seq") -> DataFrame:
    """How many insertions touched a counter that was empty, for each n; grams: n, g and a number that orders insertions.

    Every counter's first insertion is the least number that comes to it; the answer is how many numbers are first somewhere.
    """
    first = grams.groupBy("n", "g").agg(F.min(order).alias(order))
    touched = store._spots(first).groupBy("n", "spot").agg(F.min(order).alias(order))
    return touched.select("n", order).distinct().groupBy("n").agg(F.count("*").alias("distinct_estimate"))
