"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. A window is a run
of `window` consecutive item words (an item of fewer words is one window). The automaton reads word numbers. It has every
second half window of the items as a pattern: runs of (window + 1) / 2 words that start at multiples of that, of which each
window holds at least one whole. A text is scanned once; where a pattern ends, the words beside it are compared with the
item's, and runs of a window or more are hits. So the automaton has about one node a word of the items, not ten or
sixty, and finds the same windows. Matches are mapped back to words and to code point offsets of the original text.

Items are a stated query set. The automaton is built once by each worker process and takes about 10 bytes a byte of items (measured: 91 MB for 9.4 MB).
One automaton and one scan are the rule; only items of over `block_bytes` of text are read in blocks, documents then
pass the automata one after another and ranges are merged, so that no automaton outgrows a worker. Documents are never
shuffled.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; repeated
item rows count once per distinct id; an item with a null id marks words but has no id to count; an empty benchmark
hits nothing; repeated documents each get their row. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payloom.llm.common import ALNUM_TABLE, slices, stored, table, utf8

WINDOW = 10
#: Item text per automaton.
BLOCK_BYTES = 32 << 20
#: Places of a pattern in the items that are compared one by one; more are compared in numpy.
FEW = 8


class _Numbers(dict):
    """Numbers of the items' words, from 1; any other word is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class WindowAutomaton:
    """All windows of the items, as one automaton over word numbers."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        import ahocorasick

        self.window, self.half = window, (window + 1) // 2
        self.numbers = _Numbers()
        self.items: list[str | None] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.places: list[list[int]] = []  # of each pattern, in the items' words
        flat, sizes = array("i", [-1]), array("i")  # all words, -1 between items; the words of each item
        owner = array("i", [-1])
        for item_id, text in sorted(set(items), key=str):
            words = (text or b"").translate(ALNUM_TABLE).split()
            if not words:
                continue
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            half = min(self.half, len(ids))
            for i in range(0, len(ids) - half + 1 if len(ids) >= window else 1, half):
                key = tuple(ids[i : i + half])
                k = self.automaton.get(key, -1)
                if k < 0:
                    k = len(self.places)
                    self.places.append([])
                    self.automaton.add_word(key, k)
                self.places[k].append(len(flat) + i)
            flat.extend([*ids, -1])
            owner.extend([len(self.items)] * (len(ids) + 1))
            self.items.append(item_id)
            sizes.append(len(ids))
        self.flat, self.owner = np.frombuffer(flat, np.int32), np.frombuffer(owner, np.int32)
        self.least = np.minimum(np.frombuffer(sizes, np.int32), window) if len(sizes) else np.empty(0, np.int32)
        self.any = bool(self.places)
        if self.any:
            self.automaton.make_automaton()

    def _one(self, ids: tuple[int, ...], start: int, size: int, place: int) -> tuple[int, int]:
        """How many words before and after a pattern's match are the item's too, up to what a window can hold."""
        flat, most, left, right = self.flat, self.window - size, 0, 0
        while left < most and left < start and flat[place - left - 1] == ids[start - left - 1]:
            left += 1
        while right < most and start + size + right < len(ids) and flat[place + size + right] == ids[start + size + right]:
            right += 1
        return left, right

    def _many(self, ids: tuple[int, ...], start: int, size: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _one, of many places at once."""
        left, right = (np.zeros(len(places), np.int64) for _ in range(2))
        for step, count in ((-1, left), (1, right)):
            going = np.arange(len(places))
            for k in range(self.window - size):
                at = start - 1 - k if step < 0 else start + size + k
                if not 0 <= at < len(ids):
                    break
                own = places[going] - 1 - k if step < 0 else places[going] + size + k
                going = going[self.flat[own] == ids[at]]
                if not len(going):
                    break
                count[going] += 1
        return left, right

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged ranges of hit words, ids of the items found."""
        words = (text or b"").translate(ALNUM_TABLE).split()
        if not words or not self.any:
            return len(words), [], set()
        ids = tuple(map(self.numbers.__getitem__, words))
        ranges, found = [], set()
        for end, k in self.automaton.iter(ids):
            places = self.places[k]
            owner = self.owner[places[0]]
            size = min(self.half, int(self.least[owner]))
            start = end - size + 1
            if len(places) <= FEW:
                for place in places:
                    left, right = self._one(ids, start, size, place)
                    owner = self.owner[place]
                    if left + size + right >= self.least[owner]:
                        ranges.append((start - left, end + 1 + right))
                        found.add(owner)
                continue
            at = np.asarray(places)
            left, right = self._many(ids, start, size, at)
            hit = left + size + right >= self.least[self.owner[at]]
            if hit.any():
                ranges += set(zip((start - left[hit]).tolist(), (end + 1 + right[hit]).tolist(), strict=True))
                found.update(self.owner[at[hit]].tolist())
        names = (self.items[k] for k in found)
        return len(words), merged(sorted(ranges)), {i for i in names if i is not None}


_BUILT: dict[str, WindowAutomaton] = {}


def automaton_of(name: str, items: list[tuple[str | None, bytes | None]], window: int) -> WindowAutomaton:
    """The automaton of a broadcast list; a worker process keeps the last one that it built."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = WindowAutomaton(items, window)
    return _BUILT[name]


def merged(ranges) -> list[tuple[int, int]]:
    """Sorted half-open ranges, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of ranges of words."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(ALNUM_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(points[edges[2 * a]]), int(points[edges[2 * b - 1]])) for a, b in ranges]


PAIR = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pairs(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in row] for row in rows], _RANGES)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items, in lists of about block_bytes of text."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), utf8(F.col(text_col)).alias("body"))
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == b)
        yield [(r[0], r[1] if r[1] is None else bytes(r[1])) for r in part.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """One row per document: id, n_words, hit_words (ranges of words), hit_spans (code points), item_ids (sorted as strings).

    carry: instead __row, a struct of the document's own columns, and leaks, a struct of the same.
    """
    spark = docs.sparkSession
    result = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", PAIR), T.StructField("hit_spans", PAIR), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    body = "__body"
    df = docs.select(*([F.struct("*").alias("__row")] if carry else [F.col(id_col)]), utf8(F.col(text_col)).alias(body), F.lit(None).cast(result).alias("leaks"))
    for k, items in enumerate(_blocks(benchmark, item_id_col, item_text_col, block_bytes)):
        if k:  # a block more: the chain of Python stages stays short
            df = stored(df, "leaks")
        shared = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0, name=uuid4().hex) -> Iterator[pa.RecordBatch]:
            automaton = automaton_of(name, shared.value, window)
            for batch in slices(batches):
                names, texts = batch.schema.names, batch.column(body).to_pylist()
                before = [None] * len(texts) if first else batch.column("leaks").to_pylist()
                n, words, spans, ids = [], [], [], []
                for text, was in zip(texts, before, strict=True):
                    size, ranges, found = automaton.scan(text)
                    if was and was["hit_words"]:
                        ranges = merged(sorted(ranges + [(r["start"], r["end"]) for r in was["hit_words"]]))
                        found |= set(was["item_ids"])
                    n.append(size)
                    words.append(ranges)
                    spans.append(original_spans(text, ranges) if ranges else [])
                    ids.append(sorted(found))
                leaks = pa.StructArray.from_arrays([pa.array(n, pa.int64()), _pairs(words), _pairs(spans), pa.array(ids, pa.list_(pa.string()))], ["n_words", "hit_words", "hit_spans", "item_ids"])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(body), leaks], names)

        df = df.mapInArrow(scan, df.schema)
    return df.select("__row", "leaks") if carry else df.select(id_col, "leaks.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit word; their columns as they are."""
    return find_leaks(docs, benchmark, carry=True, **options).where(F.size("leaks.hit_words") == 0).select("__row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
ks AS (SELECT DISTINCT k FROM wins),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, i, p.k FROM places p JOIN wins USING (win) WHERE p.k = wins.k),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": OP1_SQL}
