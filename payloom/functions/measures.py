"""Byte entropy and small column functions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payloom.parsing import Span


@F.pandas_udf(T.DoubleType())
def byte_entropy(data: pd.Series) -> pd.Series:
    """Shannon entropy in bits of a binary column's bytes; 0 for empty, null for null."""

    out = np.full(len(data), np.nan)
    there = np.flatnonzero(data.notna().to_numpy())
    for at in range(0, len(there), 4096):
        some = there[at : at + 4096]
        parts = [bytes(x) for x in data.iloc[some]]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.frombuffer(b"".join(parts), np.uint8)
        counts = np.bincount(np.repeat(np.arange(len(parts)) * 256, size) + flat, minlength=256 * len(parts)).reshape(-1, 256)
        n = np.maximum(size, 1)[:, None]
        out[some] = np.abs((counts * np.log2(n / np.maximum(counts, 1))).sum(axis=1) / n[:, 0])
    return pd.Series(out).astype("Float64").where(data.notna().to_numpy())


def in_spans(value: Column, spans: list[Span] | None) -> Column:
    """Whether a value is in any of the ranges; None: true."""
    if spans is None:
        return F.lit(True)
    one = lambda s: (value >= s.low) if s.high == 0 else (value >= s.low) & (value <= s.high)
    return reduce(lambda a, b: a | b, map(one, spans), F.lit(False))


def in_network(host: Column, subnet: Column, mask: Column) -> Column:
    return host.bitwiseAND(mask) == subnet


def nonzero_byte(data: Column) -> Column:
    """Whether any byte isn't zero."""
    return F.hex(data).rlike("[1-9A-F]")


def printable(data: Column) -> Column:
    """Bytes 0x20-0x7E as characters, others as (decimal), in one string."""
    from payloom.functions.hashing import byte_values

    show = lambda b: F.when((b >= 0x20) & (b <= 0x7E), F.chr(b)).otherwise(F.concat(F.lit("("), b.cast("string"), F.lit(")")))
    return F.array_join(F.transform(byte_values(data), show), "")


def starts_printable(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 1)).between("20", "7E")


def packed(gram: Column) -> Column:
    """A gram of up to 7 bytes as a big-endian number."""
    return F.conv(F.hex(gram), 16, 10).cast("long")


def unsigned(data: Column, width: int, order: str = "little") -> Column:
    """Array of the unsigned numbers of width bytes (1 to 8) that follow each other; bytes left over are none."""
    size = F.floor(F.length(data) / width).cast("int")
    starts = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: i * width + 1)).otherwise(F.array().cast("array<int>"))
    steps = range(width - 1, -1, -1) if order == "little" else range(width)
    number = lambda at: F.conv(F.concat(*[F.hex(F.substring(data, at + k, F.lit(1))) for k in steps]), 16, 10).cast("decimal(20,0)")
    return F.transform(starts, number)


def network(text: Column) -> Column:
    """A dotted network, with or without /bits, as a struct (subnet, mask); null if it isn't one."""
    parts = F.split(text, "/", 2)
    bits = F.when(F.size(parts) == 1, F.lit("32")).otherwise(F.get(parts, F.lit(1)))
    width = F.when(bits.rlike(r"^\d{1,2}$"), bits).cast("int")
    mask = F.lit(0xFFFFFFFF) - (F.pow(F.lit(2.0), 32 - width).cast("long") - 1)
    host = address(parts[0])
    return F.when(host.isNotNull() & width.between(0, 32), F.struct(host.bitwiseAND(mask).alias("subnet"), mask.alias("mask")))


def unpacked(number: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2 * n, "0"))


def dotted(host: Column) -> Column:
    """An IPv4 number as text."""
    return F.concat_ws(".", *[F.shiftrightunsigned(host, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def address(text: Column) -> Column:
    """A dotted IPv4 address as a number; null if it isn't one."""
    part = lambda i: F.split(text, r"\.")[i].cast("long")
    whole = text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(whole, part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def day_number(day: Column) -> Column:
    """A date as the number yyyymmdd."""
    return F.date_format(day, "yyyyMMdd").cast("int")


def seconds_text(ts: Column) -> Column:
    """A timestamp as seconds and six digits."""
    micros = F.unix_micros(ts)
    return F.format_string("%d.%06d", F.floor(micros / 1_000_000), F.pmod(micros, F.lit(1_000_000)))
