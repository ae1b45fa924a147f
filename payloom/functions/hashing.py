"""FNV and lookup3 hashes as columns.

FNV-64 is kept as two 32-bit halves in longs (Spark's longs overflow with an error): the prime is 2^40 + 435. The halves
are also the two hashes of double hashing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of FNV: offset bases and the low parts of the primes.
BASIS_32, PRIME_32 = 0x811C9DC5, 0x01000193
BASIS_64, PRIME_64_LOW = 0xCBF29CE484222325, 0x1B3
MASK = 0xFFFFFFFF


def byte_values(col: Column) -> Column:
    """The bytes of a binary column as an array of longs; empty stays empty."""
    indices = F.when(F.length(col) > 0, F.sequence(F.lit(1), F.length(col))).otherwise(F.array().cast("array<int>"))
    return F.transform(indices, lambda i: F.conv(F.hex(F.substring(col, i, F.lit(1))), 16, 10).cast("long"))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _step32(h: Column, b: Column, variant: str) -> Column:
    if variant == "1a":
        return (h.bitwiseXOR(b) * PRIME_32).bitwiseAND(_long(MASK))
    return (h * PRIME_32).bitwiseAND(_long(MASK)).bitwiseXOR(b)


def fnv32(col: Column, variant: str = "1", bits: int = 32) -> Column:
    """FNV-0, FNV-1 or FNV-1a of a binary column as a long; bits: keep the low ones."""
    h = F.aggregate(byte_values(col), _long(0 if variant == "0" else BASIS_32), lambda acc, b: _step32(acc, b, variant))
    return h if bits == 32 else h.bitwiseAND(_long((1 << bits) - 1))


def fnv32_prefixes(col: Column, low: int, high: int, variant: str = "1") -> Column:
    """Array of structs (n, hash): the hashes of the first low..high bytes, made in one pass over the bytes."""
    kind = "struct<h:bigint,n:int,out:array<struct<n:int,hash:bigint>>>"
    start = F.struct(_long(0 if variant == "0" else BASIS_32).alias("h"), F.lit(0).alias("n"), F.array().cast("array<struct<n:int,hash:bigint>>").alias("out")).cast(kind)

    def step(acc: Column, b: Column) -> Column:
        n, h = acc["n"] + 1, _step32(acc["h"], b, variant)
        entry = F.array(F.struct(n.alias("n"), h.alias("hash")))
        return F.struct(h.alias("h"), n.alias("n"), F.when(n >= low, F.concat(acc["out"], entry)).otherwise(acc["out"]).alias("out")).cast(kind)

    return F.aggregate(byte_values(F.substring(col, 1, high)), start, step, lambda acc: acc["out"])


def _halves(basis: int) -> Column:
    return F.struct(_long(basis & MASK).alias("lo"), _long(basis >> 32).alias("hi"))


def _step64(h: Column, b: Column, variant: str) -> Column:
    lo, hi = h["lo"], h["hi"]
    if variant == "1a":
        lo = lo.bitwiseXOR(b)
    product = lo * PRIME_64_LOW
    new_lo = product.bitwiseAND(_long(MASK))
    new_hi = (hi * PRIME_64_LOW + F.shiftrightunsigned(product, 32) + lo * 256).bitwiseAND(_long(MASK))
    return F.struct((new_lo if variant == "1a" else new_lo.bitwiseXOR(b)).alias("lo"), new_hi.alias("hi"))


def fnv64_halves(col: Column, variant: str = "1") -> Column:
    """Struct (lo, hi) of the 64-bit hash."""
    return F.aggregate(byte_values(col), _halves(0 if variant == "0" else BASIS_64), lambda acc, b: _step64(acc, b, variant))


def hex64(halves: Column) -> Column:
    """The 64-bit hash as 16 lower-case hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(halves["hi"]), 8, "0"), F.lpad(F.hex(halves["lo"]), 8, "0")))


def fnv64(col: Column, variant: str = "1") -> Column:
    return hex64(fnv64_halves(col, variant))


def fnv64_prefixes(col: Column, low: int, high: int, variant: str = "1") -> Column:
    """Array of structs (n, lo, hi): the hashes of the first low..high bytes, made in one pass over the bytes."""
    kind = "struct<h:struct<lo:bigint,hi:bigint>,n:int,out:array<struct<n:int,lo:bigint,hi:bigint>>>"
    start = F.struct(_halves(BASIS_64 if variant != "0" else 0).alias("h"), F.lit(0).alias("n"), F.array().cast("array<struct<n:int,lo:bigint,hi:bigint>>").alias("out")).cast(kind)

    def step(acc: Column, b: Column) -> Column:
        n = acc["n"] + 1
        h = _step64(acc["h"], b, variant)
        entry = F.array(F.struct(n.alias("n"), h["lo"].alias("lo"), h["hi"].alias("hi")))
        return F.struct(h.alias("h"), n.alias("n"), F.when(n >= low, F.concat(acc["out"], entry)).otherwise(acc["out"]).alias("out")).cast(kind)

    return F.aggregate(byte_values(F.substring(col, 1, high)), start, step, lambda acc: acc["out"])


def spots(halves: Column, k: int, m: int) -> Column:
    """The k counters of m that double hashing gives: (lo + i * hi) mod m."""
    return F.transform(F.sequence(_long(0), _long(k - 1)), lambda i: (halves["lo"] + i * halves["hi"]) % _long(m))


# --- lookup3

# Fixed values of lookup3: the start and the rotations of its two mixing rounds.
START = 0xDEADBEEF
MIX, FINAL = (4, 6, 8, 16, 19, 4), (14, 11, 25, 16, 4, 14, 24)


def _rot(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint32(k) | x >> np.uint32(32 - k)


def _rounds(data: np.ndarray, pc: int, pb: int, order: str) -> tuple[np.ndarray, np.ndarray]:
    """lookup3 of rows of bytes of equal length: arrays c and b. Both rounds do the same to a, b and c in turn."""
    rows, size = data.shape
    a = np.full(rows, (START + size + pc) & MASK, np.uint32)
    b, c = a, a + np.uint32(pb & MASK)
    if not size:
        return c, b
    blocks = -(-size // 12)
    padded = np.zeros((rows, blocks * 12), np.uint8)
    padded[:, :size] = data
    words = padded.view("<u4" if order == "little" else ">u4").astype(np.uint32).reshape(rows, blocks, 3)
    for block in range(blocks):
        a, b, c = (v + words[:, block, i] for i, v in enumerate((a, b, c)))
        if block < blocks - 1:
            for k in MIX:
                a, b, c = b, c + b, (a - c) ^ _rot(c, k)
    for k in FINAL:
        a, b, c = b, (c ^ b) - _rot(b, k), a
    return b, a  # seven turns leave c in the place of b, and b in that of a


def lookup3(data: bytes, pc: int = 0, pb: int = 0, order: str = "little") -> tuple[int, int]:
    """Two 32-bit hashes (c, b) of bytes with two seeds."""
    c, b = _rounds(np.frombuffer(data, np.uint8).reshape(1, -1), pc, pb, order)
    return int(c[0]), int(b[0])


def lookup3_words(words: list[int], pc: int = 0, pb: int = 0) -> tuple[int, int]:
    """As lookup3, of 32-bit words."""
    return lookup3(b"".join(w.to_bytes(4, "little") for w in words), pc, pb)


@F.pandas_udf(T.LongType())
def lookup3_column(data: pd.Series) -> pd.Series:
    """The 64-bit value b x 2^32 + c of a binary column, as a signed long; payloads of one length are hashed at once."""
    out = np.zeros(len(data), np.int64)
    there = data.notna().to_numpy()
    values = data.to_numpy()
    sizes = np.fromiter((len(x) if x is not None else -1 for x in values), np.int64, len(data))
    for size in np.unique(sizes[there]):
        at = np.flatnonzero(sizes == size)
        c, b = _rounds(np.frombuffer(b"".join(bytes(values[i]) for i in at), np.uint8).reshape(len(at), size), 0, 0, "little")
        out[at] = (b.astype(np.uint64) << np.uint64(32) | c).view(np.int64)
    return pd.Series(out).astype("Int64").where(there)
