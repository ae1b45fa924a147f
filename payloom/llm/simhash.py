"""SimHash near-duplicates by tiled exact comparison.

A text's words (A-Z lower-cased) give word shingles, repeats included; each is hashed with XXH64 (seed 42), and a
fingerprint bit is set if it is set in over half of the hashes. Fingerprints link at `radius` or fewer differing bits.

Equal fingerprints are reduced to one first. The rest are tiled by the population counts of four 16-bit segments: two
fingerprints whose counts differ by more than the radius in sum cannot link, so only tile pairs within it are compared,
each exactly with numpy exclusive-or and bit counts. There are at most 17^4 tiles, so their row counts may be
broadcast; a tile of more than `CHUNK` fingerprints is dealt into chunks by hash and compared chunk by chunk, so no
task gathers a tile. A task returns a spanning forest of the links that it finds, never all pairs, and components are
closed by distributed stars.

When one document of each group is to be kept, groups are made by the exact Jaccard similarity of the sets of distinct
five-word shingles (as 64-bit hashes). Equal sets are reduced to one first. Blocks come from prefix filtering: in an order
of shingles that all texts share, sets of similarity 0.8 have a shingle in common among the first fifth of each, so texts
meet in the blocks of those shingles and nowhere else; no pair is lost there. Shingles that very many texts have come last
in the order, so a common passage makes no large block unless texts consist of it. Within a block 256-bit fingerprints are
compared by exclusive-or and bit counts, large blocks in tiles of like size and population count, of which only fitting
pairs meet, each pair a unit of work. Candidates differ in CANDIDATE bits at most, which loses a pair of similarity 0.8
with a probability below one in a million, and few others differ in so few: false candidates chain texts into components,
which would grow with the square of the corpus. Tiles give spanning forests of candidates; within each component of those all
pairs are verified by their sets, in cells of CELL texts, before anything links, so no row is made for a pair as such.
Blocks of more than PART_ROWS texts in all, and cells of more than PART_SETS sets, are compared in parts, one after another, so
that what is shuffled at a time doesn't grow with their number.

Defined results: null and wordless texts have fingerprint zero and link like others; fewer words than a shingle are one
shingle; component_id is the smallest id reached, ignoring nulls (null if there are only null ids); repeated rows each
get their row. When one row of each component is kept, it is the one with the smallest id (nulls last, then the smallest
hash of the text); of fully equal rows one stays. Other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payloom.llm.common import LOWER_TABLE, Bits, bit_filter, discard, slices, table, utf8
from payloom.llm.common import stored_by_workers as stored
from payloom.llm.components import connected, forest, split_join

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Fingerprints in a chunk of a tile: a pair of chunks is 32 MB of comparisons at most, made in pieces.
CHUNK = 4096
#: Chunks of a tile that one key holds: a chunk visits each lane of a tile by itself, so a large tile is many tasks.
LANE = 16
SEGMENTS = 4
_WIDTH = 64 // SEGMENTS
_BASE = _WIDTH + 1


def shingle_hashes(text: bytes | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of the text."""
    from xxhash import xxh64_intdigest as xxh64

    words = (text or b"").translate(LOWER_TABLE).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64(line, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - k + 1].tolist()
    return np.array([xxh64(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray, at_once: int = 1 << 16) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), at_once):
        part = hashes[a : a + at_once]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """id, content (hash of id and text, tells rows apart), fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.fromiter((majority(shingle_hashes(t, shingle_words)) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["id", "content", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), content(id_col, text_col).alias("content"), utf8(F.col(text_col)).alias("body"))
    return rows.mapInArrow(run, f"id {dict(docs.select(F.col(id_col).alias('id')).dtypes)['id']}, content long, fp long")


def content(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a (b None) or between and within the linked parts of a and b, as two arrays."""
    other = a if b is None else b
    step = max(1, (1 << 20) // max(1, len(other)))
    rows, cols = [], []
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        if b is None:
            keep = i + at < j
            i, j = i[keep], j[keep]
        rows.append(i + at)
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    if not len(i):
        return a[:0], a[:0]
    nodes = a if b is None else np.concatenate((a, b))
    root = forest(len(nodes), i, j if b is None else j + len(a))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _steps(radius: int) -> list[int]:
    """Differences of tile numbers, one of each direction, of tiles whose counts differ by the radius at most."""
    out = []
    for delta in product(range(-radius, radius + 1), repeat=SEGMENTS):
        if sum(map(abs, delta)) <= radius and delta >= (0,) * SEGMENTS:
            out.append([int(x) for x in delta])
    return out


def _segment(i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned("fp", i * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1)))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v): links that connect what is linked at radius or fewer differing bits."""
    tiled = stored(prints.select("fp", F.array(*[_segment(i).cast("int") for i in range(SEGMENTS)]).alias("tile")), "tiled")
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("n_chunks"))
    chunks = stored(
        tiled.join(F.broadcast(sizes), "tile")
        .select("tile", F.pmod(F.xxhash64("fp"), F.col("n_chunks")).alias("chunk"), "fp")
        .groupBy("tile", "chunk")
        .agg(F.collect_list("fp").alias("fps")),
        "chunks",
    )
    steps = F.explode(F.array(*[F.array(*map(F.lit, d)) for d in _steps(radius)]))
    moved = F.zip_with("tile", "step", lambda a, b: a + b)
    inside = F.forall("near", lambda x: (x >= 0) & (x <= _WIDTH))
    lane = F.floor(F.col("chunk") / LANE).cast("int")
    lanes = F.broadcast(sizes.select(F.col("tile").alias("near"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n_chunks") - 1) / LANE).cast("int"))).alias("to_lane")))
    visits = chunks.select("tile", "chunk", "fps", steps.alias("step")).select(moved.alias("near"), F.col("tile").alias("from_tile"), F.col("chunk").alias("from_chunk"), F.col("fps").alias("from_fps")).where(inside)
    visits = visits.join(lanes, "near")
    pairs = (
        chunks.withColumn("lane", lane)
        .join(visits, (F.col("tile") == F.col("near")) & (F.col("lane") == F.col("to_lane")))
        .where((F.col("tile") != F.col("from_tile")) | (F.col("chunk") <= F.col("from_chunk")))
        .select("fps", F.when((F.col("tile") != F.col("from_tile")) | (F.col("chunk") != F.col("from_chunk")), F.col("from_fps")).alias("from_fps"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            us, vs = [], []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                u, v = tile_links(a, y.values.to_numpy(zero_copy_only=False).view(np.uint64) if y.is_valid else None, radius)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64))], ["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def _groups(prints: DataFrame, key: str, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (id, content, key) -> (key, component_id, keep_content, cnt): one row per key; cnt: how many rows it has."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("content"))).alias("first")
    reps = stored(prints.groupBy(key).agg(first, F.count("*").alias("cnt")), "reps")
    roots = connected(link(reps)).withColumnRenamed("node", "linked")
    rooted = stored(reps.join(roots.hint("merge"), F.col(key) == F.col("linked"), "left").select(key, F.coalesce("root", key).alias("root"), "first", F.col("cnt").alias("rows")), "rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("cnt"))
    named = split_join(rooted.drop("first"), best, "root", rooted.count())
    return named.select(key, F.col("first.id").alias("component_id"), F.col("first.content").alias("keep_content"), F.col("rows").alias("cnt"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fp, component_id."""
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words), "prints")
    found = stored(_groups(prints, "fp", lambda reps: links(reps, radius)).drop("keep_content"), "groups")
    return split_join(prints, found, "fp", prints.count()).select(F.col("id").alias(id_col), "fp", "component_id")


# --- by similarity

SIMILARITY = 0.8
SIMILAR_WORDS = 5
#: The longs of a 256-bit fingerprint, and the differing bits that a candidate may have. At Jaccard 0.8 a bit differs with probability
#: 0.1515; ties of the majority in short texts make that 0.1875 at worst (4 against 5 shingles), and 0.1612 otherwise. Beyond 84 of
#: 256 bits lie 3e-8 of the pairs at 0.1875, 2e-11 at 0.1612 and 6e-13 of long pairs; of unlike texts 2e-8 are within (of 128 bits
#: within 48, which miss no fewer of the alike, 3e-3).
PRINT = ("a", "b", "c", "d")
CANDIDATE = 84
#: A shingle with more than this share of all shingles, so one of 1 / COMMON at most, comes last in every text's order.
COMMON = 1e-6
LEAST_COMMON = 64
#: Texts of a block in one tile.
TILE = 2048
#: Shingles of a prefix that make the first blocks.
FIRST = 4
#: Texts in blocks, and sets in pairs of cells, that are shuffled at a time: some GB of disk.
PART_ROWS, PART_SETS = 8_000_000, 500_000
#: Nodes of a cell in which sets are compared exactly, and shingles of them at once.
CELL, COLUMNS = 512, 8192
#: Blocks of so many texts at most are compared many at a time.
SMALL = 64
_BAND = 32
FLUSH_HASHES = 1 << 20
CACHE = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """XXH64 of words; a worker remembers CACHE of them."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxh64_intdigest(word, SEED)
        return h


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingle_set(text: bytes | None, words: WordHashes, k: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a shingle's hash is mixed from those of its words."""
    split = (text or b"").translate(LOWER_TABLE).split()
    if not split:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    k = min(k, len(ids))
    n = len(ids) - k + 1
    h = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ ids[j : j + n]) * _ODD
            h ^= h >> np.uint64(32)
    return np.unique(h)


def prefix(shingles: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 of n shingles in an order that all texts share: common ones last, else by hash.

    Two sets of that similarity share at least one shingle of these, whatever the order.
    """
    n = len(shingles)
    if not n:
        return shingles
    if len(common):
        at = np.searchsorted(common, shingles)
        at[at == len(common)] = 0
        last = common[at] == shingles
        if last.any():
            shingles = np.concatenate((shingles[~last], shingles[last]))
    return shingles[: n - math.ceil(similarity * n - 1e-9) + 1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def set_prints(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(id, content, body) -> id, content, node (digest of the set) of each text; and rows with no node that count shingles
    that a part of a task has often (h, c), and how many it has in all (h null)."""
    names = ["id", "content", "node", "h", "c"]
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size, id_type = WordHashes(), [], 0, None

        def often() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= 8], c[c >= 8]
            k = len(h) + 1
            none = lambda t: pa.nulls(k, t)
            return pa.RecordBatch.from_arrays([none(id_type), none(pa.int64()), none(pa.binary()), pa.array([*h.view(np.int64).tolist(), None], pa.int64()), pa.array([*c.tolist(), size], pa.int64())], names)

        for batch in slices(batches):
            id_type = batch.column(0).type
            sets = [shingle_set(t, words, shingle_words) for t in batch.column(2).to_pylist()]
            nodes = pa.array([md5(s.tobytes(), usedforsecurity=False).digest() for s in sets], pa.binary())
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, none, none], names)
            held += sets
            size += sum(map(len, sets))
            if size > FLUSH_HASHES:
                yield often()
                held, size = [], 0
        if size:
            yield often()

    return texts.mapInArrow(run, f"id {kind}, content long, node binary, h long, c long")


def common_shingles(prints: DataFrame) -> np.ndarray:
    """The hashes with over COMMON of all shingles (LEAST_COMMON at least), in order; rows are those of set_prints with no node."""
    rows = prints.where("node IS NULL").groupBy("h").agg(F.sum("c").alias("c"))
    total = rows.where("h IS NULL").first()
    least = max(LEAST_COMMON, COMMON * (total["c"] if total else 0))
    got = rows.where(F.col("h").isNotNull() & (F.col("c") > least)).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def prefixes(texts: DataFrame, reps: Bits, common: np.ndarray, similarity: float, shingle_words: int) -> DataFrame:
    """(content, body) -> node, n, a, b, c, d (256-bit fingerprint), keys (the prefix) of the texts that reps lets through."""
    shared = texts.sparkSession.sparkContext.broadcast((reps, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (wanted, last) = WordHashes(), shared.value
        for batch in slices(batches):
            batch = batch.filter(pa.array(wanted.has(batch.column(0).to_numpy())))
            sets = [shingle_set(t, words, shingle_words) for t in batch.column(1).to_pylist()]
            keys = [prefix(x, last, similarity) for x in sets]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
            flat = np.concatenate([np.empty(0, np.uint64), *keys])
            nodes = pa.array([md5(x.tobytes(), usedforsecurity=False).digest() for x in sets], pa.binary())
            bits = [_signed(np.array([majority(remixed(x, i)) for x in sets], np.uint64)) for i in range(1, len(PRINT) + 1)]
            yield pa.RecordBatch.from_arrays([nodes, pa.array([len(x) for x in sets], pa.int64()), *bits, pa.ListArray.from_arrays(offsets, _signed(flat))], ["node", "n", *PRINT, "keys"])

    return texts.select("content", "body").mapInArrow(run, "node binary, n long, a long, b long, c long, d long, keys array<long>")


def chosen_keys(rows: DataFrame, keys: Bits) -> DataFrame:
    """(node, n, a, b, c, d, group, keys) -> (key, node, n, a, b, c, d, group), a row for each key that the filter lets through."""
    shared = rows.sparkSession.sparkContext.broadcast(keys)
    names = ["node", "n", *PRINT, "group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            column = batch.column(len(names))
            flat = column.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            let = shared.value.has(flat)
            at = pa.array(owner[let])
            yield pa.RecordBatch.from_arrays([pa.array(flat[let]), *(batch.column(i).take(at) for i in range(len(names)))], ["key", *names])

    return rows.select(*names, "keys").mapInArrow(run, "key long, node binary, n long, a long, b long, c long, d long, group long")


def tiled(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, n_key, node, n, a, b, c, d, maybe group) -> (key, size, band, salt, n_salts, all): the texts of a block in tiles.

    A block of more than TILE texts is parted by size (ranges one similarity wide), population count and a hash.
    """
    fields = [c for c in ("node", "n", *PRINT, "group") if c in rows.columns]
    hot = lambda c: F.when(F.col("n_salts") > 1, c).otherwise(0).cast("int")
    pops = reduce(Column.__add__, map(F.bit_count, PRINT))
    placed = rows.withColumn("n_salts", F.ceil(F.col("n_key") / F.lit(TILE)).cast("int")).select(
        "key", "n_salts", hot(F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(1 / similarity))).alias("size"), hot(F.floor(pops / _BAND)).alias("band"),
        hot(F.pmod(F.xxhash64("node"), F.col("n_salts"))).alias("salt"), F.struct(*fields).alias("one"),
    )
    keys = ["key", "size", "band", "salt"]
    return placed.repartition(*keys).groupBy(*keys).agg(F.max("n_salts").alias("n_salts"), F.sort_array(F.collect_set("one")).alias("all"))


def tile_pairs(tiles: DataFrame) -> DataFrame:
    """(all, from_all): tiles alone (from_all null) and pairs of tiles of one block whose sizes and population counts can fit."""
    fits = (F.abs(F.col("band") - F.col("from_band")) - 1) * _BAND < CANDIDATE
    many = tiles.where("n_salts > 1")
    steps = F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("to_salt")
    visits = many.select("key", F.col("size").alias("from_size"), F.col("band").alias("from_band"), F.col("salt").alias("from_salt"), F.col("all").alias("from_all"), F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("to_size"), "n_salts")
    visits = visits.select(F.col("key").alias("from_key"), "from_size", "from_band", "from_salt", "from_all", "to_size", steps)
    pairs = many.join(visits, (F.col("key") == F.col("from_key")) & (F.col("size") == F.col("to_size")) & (F.col("salt") == F.col("to_salt")))
    later = (F.col("band") < F.col("from_band")) | ((F.col("band") == F.col("from_band")) & (F.col("salt") < F.col("from_salt")))
    pairs = pairs.where(((F.col("size") != F.col("from_size")) | later) & fits).select("all", "from_all")
    alone = tiles.where(F.size("all") > 1)
    return alone.select("all", F.lit(None).cast(alone.schema["all"].dataType).alias("from_all")).unionByName(pairs)


class _Rows:
    """The texts of tiles as arrays; group is each text's own number where texts have none."""

    def __init__(self, values: pa.StructArray):
        self.node = values.field("node")
        self.n = values.field("n").to_numpy()
        self.bits = [values.field(c).to_numpy().view(np.uint64) for c in PRINT]
        grouped = any(f.name == "group" for f in values.type)
        self.group = values.field("group").to_numpy() if grouped else None

    def near(self, i: np.ndarray, other: _Rows, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (i, j) those that can be similar."""
        far = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int16) for x, y in zip(self.bits, other.bits, strict=True))
        keep = (far <= CANDIDATE) & (np.minimum(self.n[i], other.n[j]) >= similarity * np.maximum(self.n[i], other.n[j]) - 1e-9)
        if self.group is not None:
            keep &= self.group[i] != other.group[j]
        return i[keep], j[keep]


def candidates(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(all, from_all) -> (u, v): a spanning forest of the pairs within the candidate radius and of fitting sizes, found by
    exclusive-or and bit counts; where nodes have a group, of the pairs between different groups. Never all pairs."""

    def given(nodes: pa.Array, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        root = forest(len(nodes), i, j)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], ["u", "v"])

    def big(x: _Rows, y: _Rows | None) -> Iterator[pa.RecordBatch]:
        other, shift = (x, 0) if y is None else (y, len(x.n))
        nodes = x.node if y is None else pa.concat_arrays([x.node, y.node])
        root = np.arange(len(nodes))
        step = max(1, (1 << 20) // max(1, len(other.n)))
        for at in range(0, len(x.n), step):
            far = sum(np.bitwise_count(p[at : at + step, None] ^ q[None, :]).astype(np.int16) for p, q in zip(x.bits, other.bits, strict=True))
            i, j = np.nonzero(far <= CANDIDATE)
            i, j = x.near(i + at, other, j, similarity)
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            root = forest(len(nodes), np.concatenate((i, moved)), np.concatenate((j + shift, root[moved])))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield from given(nodes, moved, root[moved])

    def small(x: _Rows, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = np.arange(len(x.n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for d in range(1, int(sizes.max(initial=0))):
            i = np.flatnonzero(place >= d)
            found.append(x.near(i, x, i - d, similarity))
        yield from given(x.node, *map(np.concatenate, zip(*found, strict=True)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            whole, other = batch.column(0), batch.column(1)
            sizes = np.diff(whole.offsets.to_numpy())
            few = (sizes <= SMALL) & other.is_null().to_numpy(zero_copy_only=False)
            if few.any():
                yield from small(_Rows(whole.filter(pa.array(few)).flatten()), sizes[few])
            for k in np.flatnonzero(~few).tolist():
                yield from big(_Rows(whole[k].values), _Rows(other[k].values) if other[k].is_valid else None)

    return pairs.mapInArrow(compare, "u binary, v binary")


def shared_counts(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """How many members each of the first `cut` sets shares with each of the others (cut 0: each with each), by products of 0/1 columns."""
    sizes = np.array([len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    owner, often = np.repeat(np.arange(len(sets)), sizes), times[place] > 1
    owner, column = owner[often], number[place[often]]
    out = np.zeros((cut or len(sets), len(sets) - cut))
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        some = (column >= low) & (column < low + COLUMNS)
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[some], column[some] - low] = 1
        out += x[: cut or len(sets)] @ x[cut:].T
    return out


def verified(roots: DataFrame, reps: DataFrame, texts: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """(u, v): links that connect the nodes whose shingle sets have a Jaccard similarity of `similarity` or more.

    roots: (node, root), components of candidates; reps: (node, first.content); texts: (content, body). Components are dealt into
    cells of CELL nodes; each pair of cells of a component is compared exactly, all its sets at once, and gives a
    spanning forest. Sets are made again, of texts that a bit filter of fixed size lets through, and go once to each pair of cells.
    """
    members = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
    members = stored(members, "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.count("*").alias("cnt"))
    cells = F.ceil(F.col("m") / CELL).cast("int")
    placed = split_join(members, sizes, "root", members.count()).select("node", "root", cells.alias("cells"), F.pmod(F.xxhash64("node"), cells).cast("int").alias("cell"))
    asked = stored(placed.join(reps.select("node", F.col("first.content").alias("content")).hint("merge"), "node"), "asked")
    shared = texts.sparkSession.sparkContext.broadcast(bit_filter(asked, "content"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in slices(batches):
            batch = batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy())))
            made = [shingle_set(t, words, shingle_words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["content", "shingles"])

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks().sort_by([("cell", "ascending"), ("node", "ascending")])
        found = [np.frombuffer(x, np.uint64) for x in cell["shingles"].to_pylist()]
        first = cell["cell"].to_numpy()
        cut = int((first == first[0]).sum()) % len(first)  # 0: a cell with itself
        n = np.array([len(x) for x in found])
        both = shared_counts(found, cut)
        i, j = np.nonzero(both >= similarity * (n[: cut or len(n), None] + n[None, cut:] - both) - 1e-9)
        root = forest(len(n), i, j + cut)
        moved = np.flatnonzero(root != np.arange(len(n)))
        nodes = cell["node"].combine_chunks()
        return pa.table([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], names=["u", "v"])

    made = texts.select("content", "body").mapInArrow(sets, "content long, shingles binary").join(asked.hint("merge"), "content").dropDuplicates(["node"])
    total = sizes.agg(F.sum(F.col("m") * F.ceil(F.col("m") / CELL))).first()[0] or 0
    parts = math.ceil(total / PART_SETS)
    own = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))
    several = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.struct(F.least(o, F.col("cell")).alias("low"), F.greatest(o, F.col("cell")).alias("high")))

    def linked(rows: DataFrame, k: int = 0) -> DataFrame:
        pairs = F.when(F.col("cells") > 1, several).otherwise(own)
        if parts > 1:
            pairs = F.filter(pairs, lambda pair: F.pmod(F.xxhash64("root", pair), F.lit(parts)) == k)
        visits = rows.withColumn("pair", F.explode(pairs))
        return visits.select("root", "pair", "cell", "node", "shingles").groupBy("root", "pair").applyInArrow(compare, "u binary, v binary")

    if parts <= 1:
        return linked(made)
    made = stored(made, "sets")
    found = [stored(linked(made, k), "links") for k in range(parts)]
    discard(made)
    return reduce(DataFrame.union, found)


def similar_links(reps: DataFrame, texts: DataFrame, common: np.ndarray, similarity: float = SIMILARITY, shingle_words: int = SIMILAR_WORDS) -> DataFrame:
    """reps (node, first), texts (content, body) -> (u, v): links that connect nodes of `similarity` or more.

    Candidates are connected first, by the blocks of each text's first FIRST shingles, which is nearly all of each group of near
    copies; then by all shingles of the prefixes, but only in blocks where different groups meet. Every pair of
    similar texts so ends in one component of candidates, and all pairs of a component are verified.
    """
    chosen = bit_filter(reps.select(F.col("first.content").alias("content")), "content")
    found = stored(prefixes(texts, chosen, common, similarity, shingle_words), "prefixes")
    rows = found.select("node", "n", *PRINT, F.explode(F.slice("keys", 1, FIRST)).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n_key")).where("n_key > 1")
    tiles = stored(tiled(rows.join(counts, "key"), similarity), "tiles")
    first = connected(candidates(tile_pairs(tiles), similarity))
    discard(tiles)
    roots = first.withColumnRenamed("node", "linked").hint("merge")
    groups = reps.join(roots, F.col("node") == F.col("linked"), "left").select("node", F.xxhash64(F.coalesce("root", "node")).alias("group"))
    grouped = stored(found.join(groups.hint("merge"), "node"), "grouped")
    discard(found)
    blocks = grouped.select(F.explode("keys").alias("key"), "group").groupBy("key").agg(F.count("*").alias("n_key"), F.min("group").alias("low"), F.max("group").alias("high"))
    blocks = stored(blocks.where("low <> high").select("key", "n_key"), "keys")
    parts = max(1, math.ceil((blocks.agg(F.sum("n_key")).first()[0] or 0) / PART_ROWS))
    links = []
    for k in range(parts):
        some = blocks.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        again = stored(tiled(chosen_keys(grouped, bit_filter(some, "key")).join(some, "key"), similarity), "tiles")
        links.append(stored(candidates(tile_pairs(again), similarity), "links"))
        discard(again)
    discard(grouped, blocks)
    roots = connected(reduce(DataFrame.union, links, first.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    discard(*links)
    return verified(roots, reps, texts, similarity, shingle_words)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents' rows, one of each group of texts that are similar; their columns as they are."""
    texts = docs.select(F.col(id_col).alias("id"), content(id_col, text_col).alias("content"), utf8(F.col(text_col)).alias("body"))
    prints = stored(set_prints(texts, shingle_words), "prints")
    common = common_shingles(prints)
    found = _groups(prints.where("node IS NOT NULL"), "node", lambda reps: similar_links(reps, texts, common, similarity, shingle_words))
    # ids in structs are equal where both are null, so one shuffle of the rows serves the join and the window
    kept = stored(found.select(F.struct(F.col("component_id").alias("id")).alias("__key"), F.col("keep_content").alias("__own")).distinct(), "kept")
    rows = docs.select(F.struct("*").alias("__row"), F.struct(F.col(id_col).alias("id")).alias("__key"), content(id_col, text_col).alias("__own"))
    joined = rows.join(kept.hint("merge"), ["__key", "__own"])
    nth = F.row_number().over(Window.partitionBy("__key", "__own").orderBy(F.lit(0)))
    return joined.withColumn("__nth", nth).where("__nth = 1").select("__row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
