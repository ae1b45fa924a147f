"""Descriptive statistics of sequences, count tables and stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block of a sequence.
BLOCK = 1 << 20


def _previous(df: DataFrame, value: str, order: str, key: str | None) -> DataFrame:
    """x and the value before it, prev. order must be a number; blocks of it are ordered one by one and joined by the last
    value of the block before, so no task has a whole sequence, be it all rows or those of one key."""
    keys = [key] if key else []
    rows = df.select(*keys, F.floor(F.col(order) / BLOCK).alias("block"), F.col(order).alias("pos"), F.col(value).cast("double").alias("x"))
    lasts = rows.groupBy(*keys, "block").agg(F.max_by("x", "pos").alias("last"))
    lasts = lasts.withColumn("before", F.lag("last").over(Window.partitionBy(*keys).orderBy("block"))).select(*[F.col(c).alias(f"__{c}") for c in (*keys, "block")], "before")
    w = Window.partitionBy(*keys, "block").orderBy("pos")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "block")])
    return rows.withColumns({"own": F.lag("x").over(w), "nth": F.row_number().over(w)}).join(lasts, same).select(*keys, "x", F.when(F.col("nth") > 1, F.col("own")).otherwise(F.col("before")).alias("prev"))


def sequence_stats(df: DataFrame, value: str, order: str, key: str | None = None) -> DataFrame:
    """count, mu, sigma, rho (lag one), min and max of a sequence, for each key if there is one."""
    pairs = _previous(df, value, order, key)
    keys = [key] if key else []
    base = pairs.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mu"), F.stddev_samp("x").alias("sigma"), F.min("x").alias("min"), F.max("x").alias("max"))
    with_mu = pairs.join(F.broadcast(base.select("mu")), how="cross") if not key else pairs.join(base.select(key, "mu"), key)
    rho = with_mu.where("prev IS NOT NULL").groupBy(*keys).agg((F.sum((F.col("x") - F.col("mu")) * (F.col("prev") - F.col("mu"))) / F.nullif(F.sum((F.col("prev") - F.col("mu")) ** 2), F.lit(0.0))).alias("rho"))
    return base.join(rho, key, "left") if key else base.join(F.broadcast(rho), how="cross")


def nonzero_stats(df: DataFrame, value: str) -> DataFrame:
    """Number, mean and deviation of the values that aren't zero."""
    return df.where(F.col(value) != 0).agg(F.count("*").alias("n"), F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"))


def weighted_stats(df: DataFrame, value: str, count: str, threshold: float | None = None) -> DataFrame:
    """Mean and deviation of values that occur count times; threshold: only counts from it on."""
    if threshold is not None:
        df = df.where(F.col(count) >= threshold)
    n, s, q = F.sum(count), F.sum(F.col(value) * F.col(count)), F.sum(F.col(value) * F.col(value) * F.col(count))
    variance = (q - s * s / n) / F.nullif(n - 1, F.lit(0))
    return df.agg(n.alias("n"), (s / n).alias("mu"), F.sqrt(F.when(variance < 0, 0.0).otherwise(variance)).alias("sigma"))


def count_entropy(df: DataFrame, count: str) -> DataFrame:
    """Shannon entropy in bits of a count table, from two sums: log2 N - sum(c log2 c) / N."""
    rows = df.where(F.col(count) > 0)
    return rows.agg((F.log2(F.sum(count)) - F.sum(F.col(count) * F.log2(F.col(count))) / F.sum(count)).alias("entropy"))


def slot_stats(slots: DataFrame, m: int | Column, count: str = "cnt", key: str = "n") -> DataFrame:
    """mu, sigma, max, min, chi-square over all m counters, of which only those above zero are rows."""
    size = m if isinstance(m, Column) else F.lit(m)
    sums = slots.groupBy(key).agg(F.sum(count).cast("double").alias("s"), F.sum(F.col(count).cast("double") * F.col(count)).alias("q"), F.max(count).alias("max"), F.min(count).alias("least"), F.count("*").alias("nonzero"))
    rows = sums.withColumn("m", size.cast("double")).withColumn("mu", F.col("s") / F.col("m"))
    chi = (F.col("q") - F.col("m") * F.col("mu") ** 2) / F.col("mu")
    sigma = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("m") * F.col("mu") ** 2) / (F.col("m") - 1)))
    return rows.select(key, "mu", sigma.alias("sigma"), "max", F.when(F.col("nonzero") < F.col("m"), 0).otherwise(F.col("least")).alias("min"), chi.alias("chi_square"), "nonzero")


def gram_thresholds(counts: DataFrame) -> DataFrame:
    """total, distinct and how many grams have 100, 1000 and 10000 hits at least, for each n."""
    at = lambda k: F.count_if(F.col("cnt") >= k)
    return counts.groupBy("n").agg(F.sum("cnt").alias("total"), F.count("*").alias("distinct_grams"), at(100).alias("ge_100"), at(1000).alias("ge_1000"), at(10000).alias("ge_10000"))


def range_sum(df: DataFrame, index: str, value: str, low: int, high: int) -> DataFrame:
    return df.where(F.col(index).between(low, high)).agg(F.sum(value).alias("total"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(bin, cnt): values rounded to the nearest integer, halves to even."""
    return df.where(F.col(value).isNotNull()).groupBy(F.rint(value).cast("long").alias("bin")).agg(F.count("*").alias("cnt"))


def mode(df: DataFrame, value: str) -> DataFrame:
    """The first bin with most values, the smallest fuzz whose window around it has over half of all, and that share.

    Bins are rounded values; the running sums are over bins, not rows.
    """
    bins = histogram(df, value)
    total = F.sum("cnt").alias("total")
    top = bins.agg(F.min_by("bin", F.struct(-F.col("cnt"), F.col("bin"))).alias("mode"), total)
    around = bins.join(F.broadcast(top), how="cross").groupBy(F.abs(F.col("bin") - F.col("mode")).alias("fuzz"), "mode", "total").agg(F.sum("cnt").alias("cnt"))
    mass = around.withColumn("mass", F.sum("cnt").over(Window.partitionBy("mode").orderBy("fuzz")))
    enough = mass.where(F.col("mass") > F.floor(F.col("total") / 2))
    return enough.groupBy("mode").agg(F.min("fuzz").alias("fuzz"), F.min_by(F.col("mass") / F.col("total"), "fuzz").alias("fraction"))


def fuzz_mode(df: DataFrame, value: str, fuzz: int) -> DataFrame:
    """The first bin whose window of +-fuzz bins has most values, and its share."""
    w = Window.orderBy("bin").rangeBetween(-fuzz, fuzz)
    sums = histogram(df, value).select("bin", "cnt", F.sum("cnt").over(w).alias("mass"))
    return sums.agg(F.min_by("bin", F.struct(-F.col("mass"), F.col("bin"))).alias("mode"), F.max("mass").alias("mass"), (F.max("mass") / F.sum("cnt")).alias("fraction"))
