"""Overlapping byte grams and their exact counts.

Counting is done where the bytes are: each task counts the grams of its Arrow batches with numpy and hands on one row per
distinct gram, so the one shuffle carries (n, gram, count) and not a row per byte. explode_grams gives the plain rows.

Grams of LONG bytes and more are nearly all distinct, and their bytes overlap. Of those, runs of neighbours are shuffled: each gram has
a key, the least hash of the windows of WINDOW bytes in it, which neighbours mostly share, so a run of them goes as one string of a few bytes
a gram. A task compresses the runs of each bucket of keys together, which leaves about half of that. Equal grams have equal keys and are
counted, exactly, where their bucket comes together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTER_MAX = 0xFFF0
#: Positions counted at once in a task.
CHUNK = 1 << 22
#: Grams from this size on are shuffled as runs; bytes of the windows that give a run its key.
LONG, WINDOW = 24, 12
#: Bits of a key, and the first of them, which are its bucket; fewer would only put more grams together.
KEY_BITS, BUCKET_BITS = 24, 9
#: Bytes of runs that a task compresses at once, and about those that it unpacks at once.
UNIT = 3 << 24


def grams_of(col: Column, n: Column) -> Column:
    """Array of all overlapping grams of n bytes; empty if there are fewer bytes."""
    at = F.when(F.length(col) >= n, F.sequence(F.lit(1), F.length(col) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(col, i, n))


def explode_grams(df: DataFrame, low: int, high: int | None = None, *, payload: str = "payload", keep: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """A row per gram: keep..., n, pos (from 0), g. compat: payloads under high - 1 bytes give nothing."""
    high = high or low
    rows = df.where(F.length(payload) >= (high - 1 if compat else low))
    rows = rows.select(*keep, payload, F.explode(F.array(*map(F.lit, range(low, high + 1)))).alias("n"))
    return rows.select(*keep, "n", F.posexplode(grams_of(F.col(payload), F.col("n"))).alias("pos", "g"))


def _words(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n bytes (8 at least) from each place as words of 8 bytes, the last of which overlaps."""
    if not len(at):
        return [np.empty(0, np.uint64)] * len(range(0, n, 8))
    eight = sliding_window_view(data, 8)
    return [np.ascontiguousarray(eight[at + low]).view(">u8")[:, 0].astype(np.uint64) for low in [*range(0, n - 8, 8), n - 8]]


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    mixed = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for code in parts:
            mixed = (mixed ^ code) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return mixed


def _count(data: np.ndarray, left: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of n bytes as rows of bytes, and their counts; left: bytes from each place to its payload's end; weight: how often
    each place counts (grams of over 8 bytes only)."""
    at = np.flatnonzero(left >= n)
    if n <= 8:
        code = np.zeros(len(at), np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | data[at + k]
        if n <= 3:
            counts = np.bincount(code.astype(np.int64), minlength=0)
            code = np.flatnonzero(counts).astype(np.uint64)
            counts = counts[code.astype(np.int64)]
        else:
            code, counts = np.unique(code, return_counts=True)
        return code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - n :], counts
    if not len(at):
        return np.empty((0, n), np.uint8), np.empty(0, np.int64)
    times = np.ones(len(at), np.int64) if weight is None else weight[at]
    # grouped by a hash that is checked
    parts = _words(data, at, n)
    mixed = _mixed(parts)
    order = np.argsort(mixed)
    new = np.append(True, mixed[order][1:] != mixed[order][:-1])
    if all(((code[order][1:] == code[order][:-1]) | new[1:]).all() for code in parts):
        first = np.flatnonzero(new)
        return sliding_window_view(data, n)[at[order[first]]], np.add.reduceat(times[order], first)
    rows = np.ascontiguousarray(sliding_window_view(data, n)[at])
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[first], np.add.reduceat(times[order], first)


def _binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] of each pair."""
    cuts = np.concatenate(([0], np.cumsum(ends - starts)))
    body = np.empty(cuts[-1], np.uint8)
    for a in range(0, len(starts), 1 << 14):
        b = min(a + (1 << 14), len(starts))
        body[cuts[a] : cuts[b]] = data[np.repeat(starts[a:b] - cuts[a:b], ends[a:b] - starts[a:b]) + np.arange(cuts[a], cuts[b])]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])


def _runs(data: np.ndarray, left: np.ndarray, n: int) -> pa.Table:
    """(key, body, cnt): strings that have all grams of n bytes, each in one; the grams of a string share their key."""
    at = np.flatnonzero(left >= n)
    if not len(at):
        return pa.table({"key": pa.array([], pa.int64()), "body": pa.array([], pa.binary()), "cnt": pa.array([], pa.int64())})
    least, span, width = _mixed(_words(data, np.arange(len(data) - WINDOW + 1), WINDOW)), 1, n - WINDOW + 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    key = np.minimum(least[at], least[at + width - span])
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (left[at[1:]] != left[at[:-1]] - 1)))
    last = np.append(first[1:], len(at)) - 1
    body = _binary(data, at[first], at[last] + n)
    with np.errstate(over="ignore"):  # the least hashes have few high bits: mixed once more
        key = _mixed([key[first]]) >> np.uint64(64 - KEY_BITS)
    return pa.table({"key": pa.array(key.astype(np.int64)), "body": body, "cnt": pa.array(np.ones(len(first), np.int64))})


def _distinct(runs: pa.Table) -> pa.Table:
    return runs.group_by(["key", "body"]).aggregate([("cnt", "sum")]).rename_columns(["key", "body", "cnt"])


def _blocks(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of some payloads (of CHUNK bytes, or one of more), and from each place those to its payload's end; 0 in payloads under shortest."""
    for batch in batches:
        column = batch.column(0).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
            a, b = int(offsets[first]), int(offsets[last])
            sizes = np.diff(offsets[first : last + 1])
            ends = np.repeat(offsets[first + 1 : last + 1] - a, sizes)
            left = ends - np.arange(b - a)
            left[np.repeat(sizes < shortest, sizes)] = 0
            yield raw[a:b], left
            first = last


def _counted(n: int, grams: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(counts):
        body = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((np.arange(len(counts) + 1) * n).astype(np.int32).tobytes()), pa.py_buffer(grams.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), n, np.int32)), body, pa.array(counts.astype(np.int64))], ["n", "g", "cnt"])


def _packed(runs: pa.Table) -> pa.RecordBatch:
    """(key, body, cnt) -> (bucket, runs, size, body): the runs of each bucket in the order of their keys, compressed."""
    runs = runs.sort_by("key")
    key, cnt, column = runs["key"].to_numpy(), runs["cnt"].to_numpy(), runs["body"].combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, codec, low = np.frombuffer(column.buffers()[2] or b"", np.uint8), pa.Codec("zstd", 3), KEY_BITS - BUCKET_BITS
    bucket, rest = key >> low, key & ((1 << low) - 1)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    last, sizes, bodies = np.append(first[1:], len(key)), [], []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        parts = np.diff(rest[a:b], prepend=0).astype("<u2"), np.diff(offsets[a : b + 1]).astype("<u4"), cnt[a:b].astype("<i8"), data[offsets[a] : offsets[b]]
        body = b"".join(x.tobytes() for x in parts)
        sizes.append(len(body))
        bodies.append(codec.compress(body, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "runs", "size", "body"])


def _packs(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for runs in chain(tables, [None]):
        if runs is not None and len(runs):
            held.append(runs)
        if held and (runs is None or sum(x.nbytes for x in held) >= UNIT):
            yield _packed(_distinct(pa.concat_tables(held)))
            held = []


def _unpacked(packs: list[dict], low: int, high: int) -> pa.Table:
    """(key, body, cnt), in the order of key: the runs of a bucket's packs whose keys' last bits are from low to before high."""
    parts = []
    for pack in packs:
        n, raw = pack["runs"], np.frombuffer(pa.Codec("zstd").decompress(pack["body"], pack["size"]), np.uint8)
        key, sizes, cnt = np.cumsum(raw[: 2 * n].view("<u2"), dtype=np.int64), raw[2 * n : 6 * n].view("<u4"), raw[6 * n : 14 * n].view("<i8")
        a, b = np.searchsorted(key, [low, high]).tolist()
        at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        body = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at[a : b + 1] - at[a]).astype(np.int32).tobytes()), pa.py_buffer(raw[14 * n + at[a] : 14 * n + at[b]].tobytes())])
        parts.append(pa.table({"key": pa.array(key[a:b] | pack["bucket"] << (KEY_BITS - BUCKET_BITS)), "body": body, "cnt": pa.array(cnt[a:b].astype(np.int64))}))
    return pa.concat_tables(parts).sort_by("key")


def _unpacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs in the order of bucket -> their runs in the order of key; of a large bucket some keys at a time."""
    rows = (pack for batch in batches for pack in batch.to_pylist())
    for _, group in groupby(rows, lambda pack: pack["bucket"]):
        packs, most = list(group), 1 << (KEY_BITS - BUCKET_BITS)
        ranges = -(-sum(pack["size"] for pack in packs) // UNIT)
        for k in range(ranges):
            yield from (b for b in _unpacked(packs, most * k // ranges, most * (k + 1) // ranges).to_batches(10_000) if b.num_rows)


def _weighted(runs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all runs, from each place those to its run's end, and how often it counts."""
    column = runs["body"].combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    left = np.repeat(offsets[1:] - offsets[0], sizes) - np.arange(len(data))
    return data, left, np.repeat(runs["cnt"].to_numpy(), sizes)


def _count_runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of runs that come in the order of key; some keys at a time, each whole."""
    held: list[pa.Table] = []
    size = 0

    def counted() -> Iterator[pa.RecordBatch]:
        data, left, weight = _weighted(_distinct(pa.concat_tables(held)))
        yield from _counted(n, *_count(data, left, n, weight))

    for batch in batches:
        part = pa.Table.from_batches([batch])
        if size >= CHUNK:
            cut = int(np.searchsorted(part["key"].to_numpy(), held[-1]["key"][-1].as_py(), "right"))
            if cut < len(part):
                held.append(part.slice(0, cut))
                yield from counted()
                held, size, part = [], 0, part.slice(cut)
        held.append(part)
        size += part.nbytes
    if held:
        yield from counted()


def _long_counts(rows: DataFrame, n: int, shortest: int) -> DataFrame:
    """(n, g, cnt) of the grams of n bytes, LONG at least: by runs."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packs(_runs(data, left, n) for data, left in _blocks(batches, shortest))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count_runs(_unpacks(batches), n)

    found = rows.mapInArrow(runs, "bucket int, runs int, size long, body binary")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "n int, g binary, cnt long")


def gram_counts(df: DataFrame, low: int, high: int | None = None, *, payload: str = "payload", compat: bool = False, only: tuple[int, ...] | None = None) -> DataFrame:
    """(n, g, cnt) for all grams of low..high bytes of the payloads; null payloads have none.

    only: the sizes of low..high that are counted and returned (compat's rule stays that of the whole range).
    """
    high = high or low
    asked = [n for n in range(low, high + 1) if only is None or n in only]
    short, shortest = [n for n in asked if n < LONG], high - 1 if compat else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, left in _blocks(batches, shortest):
            for n in short:
                yield from _counted(n, *_count(data, left, n))

    rows = df.where(F.col(payload).isNotNull()).select(payload)
    found = [_long_counts(rows, n, shortest) for n in asked if n >= LONG]
    if short or not found:
        found.insert(0, rows.mapInArrow(run, "n int, g binary, cnt long").groupBy("n", "g").agg(F.sum("cnt").alias("cnt")))
    return reduce(DataFrame.unionByName, found)


def saturated(counts: DataFrame) -> DataFrame:
    """The counter as 16 bits hold it, and how many hits went over."""
    return counts.withColumns({"counter": F.least("cnt", F.lit(COUNTER_MAX)), "overflow": F.greatest(F.col("cnt") - COUNTER_MAX, F.lit(0))})


def chunks(df: DataFrame, size: int, *, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of a fixed size of each payload: keep..., seq, payload. Empty payloads give one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.length(payload) / size)).cast("int")
    rows = df.select(*keep, payload, F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return rows.select(*keep, "seq", F.substring(F.col(payload), F.col("seq") * size + 1, F.lit(size)).alias(payload))
