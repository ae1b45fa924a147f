"""Token ids in directly addressable codes.

Documents are dealt out by ranges of their id and sorted, encoded with a tokenizer file, closed with an end id, and
packed into shards. A shard's ids are split into 8-bit chunk levels: level 0 has the low chunk of every id, level k the
k-th chunk of those ids that need it; a bitmap at each level tells which ids go on, and a directory of set bits before
each block of 512 leads from an id's place in one level to its place in the next. Any id can be read with one step a
level, without decoding its neighbours.

Files are written and read by Spark (one row per shard: partition, seq, doc_ids, n_tokens, codes), so any store that
Spark reaches will do. Positions come from shard totals: running sums over partitions (as many rows as partitions) and
within a partition.

Encoding: parts of words repeat a lot, so each worker process keeps the ids of `CACHE_WORDS` distinct ones before it forgets
those that came least; those of all new parts of a slice are found by one call of the tokenizer's own model. Texts with
characters outside `SAFE` are encoded whole by the library. Both give the library's ids.

Defined results: a null text is empty and has the end id alone; ids are stored in ascending order with null ids first,
ties in the order of the text's hash; repeated rows are stored as often as they come. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payloom.llm.common import partitions_for, shared_path, slices, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Tokens after which a shard ends; documents aren't split.
SHARD_TOKENS = 1 << 20
#: Distinct parts of words that a worker process remembers at most, but for those of one slice.
CACHE_WORDS = 300_000
#: Lists whose ids are put together at once, few enough for a processor's cache.
GATHER = 1 << 15
BLOCK_BITS = 512
MAGIC = b"DAC1"

#: Characters that stay the same in NFC and of which lower-casing gives one character.
SAFE = "\t\n\r" + "".join(map(chr, range(0x20, 0x7F))) + "".join(chr(c) for c in range(0xA1, 0x180) if c not in (0xAD, 0x130, 0x149))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- the codes ---------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        low = (rest & 0xFF).astype(np.uint8)
        rest = rest >> 8
        more = rest > 0
        bits = np.packbits(np.pad(more, (0, -len(more) % BLOCK_BITS)), bitorder="little")
        per_block = np.bitwise_count(bits.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        before = (np.cumsum(per_block) - per_block).astype("<u4")
        levels.append(struct.pack("<Q", len(low)) + low.tobytes() + bits.tobytes() + before.tobytes())
        if not more.any():
            return MAGIC + struct.pack("<BQ", len(levels), len(ids)) + b"".join(levels)
        rest = rest[more]


class Codes:
    """Reads packed codes: all ids, or the i-th."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        n_levels, self.n = struct.unpack_from("<BQ", blob, 4)
        at, self.levels = 13, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            blocks = -(-n // BLOCK_BITS)
            low = np.frombuffer(blob, np.uint8, n, at + 8)
            bits = np.frombuffer(blob, np.uint8, blocks * BLOCK_BITS // 8, at + 8 + n)
            before = np.frombuffer(blob, "<u4", blocks, at + 8 + n + len(bits))
            self.levels.append((low, bits, before))
            at += 8 + n + len(bits) + 4 * blocks

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for low, bits, before in self.levels:
            value |= int(low[i]) << shift
            shift += 8
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            inside = bits[block * BLOCK_BITS // 8 : i >> 3]
            i = int(before[block]) + int(np.bitwise_count(inside).sum()) + (int(bits[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
        return value

    def all(self) -> np.ndarray:
        low, _, _ = self.levels[-1]
        out = low.astype(np.uint32)
        for low, bits, _ in reversed(self.levels[:-1]):
            upper, out = out, low.astype(np.uint32)
            out[np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)] |= upper << 8
        return out


# --- encoding ----------------------------------------------------------------------------------------------------


def _classes() -> tuple[str, str]:
    kinds = {c: unicodedata.category(c)[0] for c in {*SAFE, *SAFE.lower()}}
    quoted = lambda kind: "".join(re.escape(c) for c in sorted(kinds) if kinds[c] == kind)
    return quoted("L"), quoted("N")


class _Lists:
    """Lists of token ids, one after another."""

    def __init__(self):
        self.start, self.size, self.pool = array("q"), array("q"), array("I")

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        sizes = sizes.astype(np.int64)
        self.start.frombytes((len(self.pool) + np.cumsum(sizes) - sizes).tobytes())
        self.size.frombytes(sizes.tobytes())
        self.pool.frombytes(ids.astype(np.uint32).tobytes())

    def cut(self, lists: int, ids: int) -> None:
        """Forget all after the first lists and ids."""
        del self.start[lists:], self.size[lists:], self.pool[ids:]

    def get(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists at these places, and how many each has."""
        start, size, pool = np.frombuffer(self.start, np.int64), np.frombuffer(self.size, np.int64), np.frombuffer(self.pool, np.uint32)
        sizes, out = size[place], [np.empty(0, np.uint32)]
        for at in range(0, len(place), GATHER):
            part = sizes[at : at + GATHER]
            before = np.cumsum(part)
            out.append(pool[np.repeat(start[place[at : at + GATHER]] - before + part, part) + np.arange(before[-1])])
        return np.concatenate(out), sizes


class WordEncoder(dict):
    """Numbers parts of words; the token ids of a part are the list at its number, list 0 is the end id. `learn` makes the lists of new parts."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.model = Tokenizer(self.tokenizer.model)  # of parts as they are: no normalizer, nothing parted further
        self.cache_words = cache_words
        letters, numbers = _classes()
        self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+").findall
        self.unsafe = re.compile(f"[^{re.escape(SAFE)}]").search
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in {*SAFE, *SAFE.lower()} if not c.isspace()}
        self.new: list[str] = []
        self.lists, self.seen = _Lists(), np.zeros(1, np.int64)
        self.lists.add(np.array([END_ID]), np.ones(1))

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self) + 1
        self.new.append(part)
        return number

    def learn(self) -> None:
        """Make the lists of the parts that were new."""
        if self.new:
            got = self.model.encode([p if p.isascii() else p.translate(self.as_bytes) for p in self.new], is_pretokenized=True, add_special_tokens=False)
            self.lists.add(np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(self.new)))
            self.new.clear()

    def shrink(self) -> None:
        """Keep the parts that came most often, half of the cache at most and none that came once."""
        seen = self.seen[1:]
        stays = seen > max(1, np.partition(seen, -(self.cache_words // 2) - 1)[-(self.cache_words // 2) - 1])
        ids, sizes = self.lists.get(np.append(0, np.flatnonzero(stays) + 1))
        parts = [part for part, stay in zip(self, stays.tolist(), strict=True) if stay]
        self.clear()
        self.update(zip(parts, range(1, len(parts) + 1), strict=True))
        self.lists, self.seen = _Lists(), np.zeros(len(parts) + 1, np.int64)
        self.lists.add(ids, sizes)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, each with the end id; number of ids of each."""
        if len(self) > self.cache_words:
            self.shrink()
        numbers, ends, whole = [], [], []
        for text in texts:
            if text and (self.unsafe(text) or "<|" in text):
                whole.append((len(numbers), self.tokenizer.encode(text, add_special_tokens=False).ids))
                numbers.append(0)
            elif text:
                numbers += map(self.__getitem__, self.parts(text.lower()))
            numbers.append(0)
            ends.append(len(numbers))
        self.learn()
        place = np.array(numbers, np.int64)
        known = len(self.lists.start), len(self.lists.pool)
        self.seen = np.bincount(place, minlength=known[0]) + np.pad(self.seen, (0, known[0] - len(self.seen)))
        for at, ids in whole:
            place[at] = len(self.lists.start)
            self.lists.add(np.array(ids, np.uint32), np.array([len(ids)]))
        ids, sizes = self.lists.get(place)
        self.lists.cut(*known)
        return ids, np.diff(np.cumsum(sizes)[np.array(ends, np.int64) - 1], prepend=0)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# --- the files ---------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Write the token ids of docs to path, in ascending order of id."""
    file = tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    tie = F.xxhash64("body")
    rows = rows.repartitionByRange(partitions_for(docs), "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        names, counts, ids, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays(names)
            lists = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            sizes = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), pa.array(np.concatenate(counts), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), lists, sizes, pa.array([held], pa.int64()), pa.array([pack(np.concatenate(ids))], pa.binary())], ["partition", "seq", "doc_ids", "n_tokens", "total", "codes"])

        encode = encoder(file).encode
        for batch in slices(batches):
            got, sizes = encode(batch.column(1).to_pylist())
            names.append(batch.column(0))
            counts.append(sizes)
            ids.append(got)
            held += len(got)
            if held >= SHARD_TOKENS:
                yield shard()
                seq, held = seq + 1, 0
                names, counts, ids = [], [], []
        if held:
            yield shard()

    kind = dict(rows.dtypes)["doc_id"]
    rows.mapInArrow(shards, f"partition int, seq int, doc_ids array<{kind}>, n_tokens array<long>, total long, codes binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each stored document."""
    stored = spark.read.parquet(path)
    sizes = stored.select("partition", "seq", "total")
    parts = sizes.groupBy("partition").agg(F.sum("total").alias("all")).select("partition", (F.sum("all").over(Window.orderBy("partition")) - F.col("all")).alias("part_start"))
    inside = F.sum("total").over(Window.partitionBy("partition").orderBy("seq")) - F.col("total")
    starts = sizes.select("partition", "seq", inside.alias("inside")).join(parts, "partition").select("partition", "seq", (F.col("inside") + F.col("part_start")).alias("shard_start"))
    kind = stored.schema["doc_ids"].dataType.elementType
    fields = [("partition", T.IntegerType()), ("seq", T.IntegerType()), ("doc_id", kind), ("offset", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = Codes(batch.column(4)[0].as_py()).all()
            names, sizes = batch.column(2)[0].values, batch.column(3)[0].values.to_numpy()
            ends = np.cumsum(sizes)
            raw = memoryview(ids.astype("<u4").tobytes())
            n = len(sizes)
            crc = [zlib.crc32(raw[4 * (b - s) : 4 * b]) for b, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
            columns = [pa.array(np.full(n, batch.column(i)[0].as_py(), np.int32)) for i in (0, 1)] + [names, pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [f[0] for f in fields])

    docs = stored.select("partition", "seq", "doc_ids", "n_tokens", "codes").mapInArrow(unpack, T.StructType([T.StructField(*f) for f in fields]))
    return docs.join(starts, ["partition", "seq"]).select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)


QUERIES = {"op10_token_store": op10_token_store}
ORACLES: dict[str, str] = {}
