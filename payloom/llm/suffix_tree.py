"""Language-model scores by a probabilistic suffix tree over words.

Tokens are words (A-Z lower-cased, parted by ASCII white space) and one end per text. What the tree holds grows with N,
the number of training tokens, as its square root, so it stays a small share of the corpus and yet never stops growing:

- contexts of up to `DEPTH` tokens that occur sqrt(N) / `CONTEXTS` times at least (8 at least) become nodes, so
  CONTEXTS x sqrt(N) a depth at most; depths end where no context is left;
- a node names the next tokens that follow it sqrt(N) / `NEXTS` times at least (twice at least), so NEXTS x sqrt(N) a depth at
  most; what it doesn't name, and a discount of what it names, is shared out as its parent does;
- a node is retained as a state if count x divergence (Kullback-Leibler, from its parent's smoothed distribution)
  exceeds `DIVERGENCE` x ln N.

These bounds are what is broadcast: some 20 bytes a node or named token, for 10^9 tokens 16 MB a depth at most, for 10^13 (60 TB of
text) 1.6 GB a depth at most; a tenth of that has been measured, as most text is in rarer grams. The words that may
be named are broadcast too: those of probability `P_WORD` at least (1 / P_WORD at most) or as frequent as a named token.

Each token is scored from the longest retained suffix of what precedes it in its text. The root is the add-one unigram
distribution over all training tokens, without any cut: occurrences of words that aren't broadcast get their counts through
a shuffled join with the full word table, which grows with the corpus. Words that training text has not are told by
a bit filter of fixed size before that join, so a word that only held-out text has is no hot key. Texts are turned
into ids once; each depth counts on those, and they are scored. All counts are taken over the whole training part by distributed sums.

Defined results: a null text is empty and has the end alone; a null id counts as empty text in the remainder; repeated
rows each get their row; with no training rows every token has log probability log10(1 / 1) = 0. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom.llm.common import LOWER_TABLE, bit_filter, remainder, slices, stored, table, utf8

DEPTH = 5
CONTEXTS, LEAST_CONTEXT = 8, 8
NEXTS, LEAST_NEXT = 32, 2
P_WORD = 1e-6
DIVERGENCE = 3.0
DISCOUNT = 0.75
END = b"\n"
MODULUS, HELD = 7, 2
#: Tokens that a worker counts before it hands counts on.
FLUSH_TOKENS = 1 << 21
FLUSH_WORDS = 300_000


class WordIds(dict):
    """Ids of the broadcast words; any other word has the id `other`."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: i for i, w in enumerate(words)})
        self.other = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.other


@dataclass
class Tree:
    """Nodes are numbered by depth; node -1 is the root. keys: for each depth, (shorter node, older word) in order."""

    words: list[bytes]
    counts: np.ndarray
    n: int = 0
    v: int = 0
    keys: list[np.ndarray] = field(default_factory=list)
    nodes: list[np.ndarray] = field(default_factory=list)
    suffix: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    state: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    log_rest: np.ndarray = field(default_factory=lambda: np.empty(0))
    named: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    named_log: np.ndarray = field(default_factory=lambda: np.empty(0))

    @property
    def width(self) -> int:
        return len(self.words) + 1

    def root(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + self.v + 1))

    def longest(self, ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
        """For each token the node of the longest context of up to `depth` tokens before it; starts: where texts begin."""
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        node = np.full(len(ids), -1, np.int64)
        going = np.ones(len(ids), bool)
        for d in range(min(depth, len(self.keys))):
            if d == 0:  # contexts of one word by a table, not by search
                table = np.full(self.width, -1, np.int64)
                table[self.keys[0] % self.width] = self.nodes[0]
                node[1:] = np.where(place[1:] > 0, table[ids[:-1]], -1)
                going = node >= 0
                continue
            at = np.flatnonzero(going & (place > d))
            key = (node[at] + 1) * self.width + ids[at - d - 1]
            slot = np.searchsorted(self.keys[d], key)
            slot[slot == len(self.keys[d])] = 0
            found = self.keys[d][slot] == key if len(self.keys[d]) else np.zeros(len(at), bool)
            going[:] = False
            going[at[found]] = True
            node[at[found]] = self.nodes[d][slot[found]]
        return node

    def depth_of(self, depth: int) -> tuple[int, int]:
        """The range of node numbers at a depth, from 1."""
        before = sum(len(x) for x in self.nodes[: depth - 1])
        return before, before + len(self.nodes[depth - 1])

    def log_probability(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; for the id of other words, without the root's part."""
        node = self.longest(ids, starts, len(self.keys))
        state = np.where(node >= 0, self.state[node], -1) if len(self.state) else node
        out = np.zeros(len(ids))
        open_ = np.flatnonzero(state >= 0)
        done = np.zeros(len(ids), bool)
        while len(open_):
            key = state[open_] * self.width + ids[open_]
            slot = np.searchsorted(self.named, key)
            slot[slot == len(self.named)] = 0
            found = self.named[slot] == key if len(self.named) else np.zeros(len(open_), bool)
            hit = open_[found]
            out[hit] += self.named_log[slot[found]]
            done[hit] = True
            open_ = open_[~found]
            out[open_] += self.log_rest[state[open_]]
            up = self.suffix[state[open_]]
            state[open_] = np.where(up >= 0, self.state[up], -1)
            open_ = open_[state[open_] >= 0]
        rest = ~done & (ids < len(self.words))
        out[rest] += self.root(self.counts)[ids[rest]]
        return out


def _tokens(texts: list[bytes | None], ids: WordIds) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Token ids of all texts, where each starts, and their words."""
    words = [(t or b"").translate(LOWER_TABLE).split() + [END] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((i for w in words for i in map(ids.__getitem__, w)), np.int64, int(sizes.sum()))
    return flat, np.cumsum(sizes) - sizes, words


def count_words(texts: DataFrame) -> DataFrame:
    """Column body -> (word, c), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update((text or b"").translate(LOWER_TABLE).split())
            counts[END] += batch.num_rows
            if len(counts) > FLUSH_WORDS:
                yield rows()
                counts.clear()
        if counts:
            yield rows()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def tokenize(docs: DataFrame, named: list[bytes], words: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (tells rows apart), ids (each token's place in named, len(named) for others), rare (the others that the table
    words has, by a bit filter), absent (how many others it surely has not)."""
    shared = docs.sparkSession.sparkContext.broadcast((named, bit_filter(words.select(F.xxhash64("word").alias("h")), "h")))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("key"), utf8(F.col(text_col)).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        places, known = WordIds(shared.value[0]), shared.value[1]
        for batch in slices(batches):
            flat, starts, split = _tokens(batch.column(2).to_pylist(), places)
            at = np.flatnonzero(flat == places.other)
            text = np.searchsorted(starts, at, "right") - 1
            found = [split[t][i] for t, i in zip(text.tolist(), (at - starts[text]).tolist(), strict=True)]
            there = known.has(np.fromiter((xxh64_intdigest(w, 42) for w in found), np.uint64, len(found)).view(np.int64))
            counts = np.bincount(text[there], minlength=len(split))
            rare = pa.ListArray.from_arrays(_offsets(counts), pa.array(found, pa.binary()).filter(pa.array(there)))
            ids = pa.ListArray.from_arrays(_offsets(np.diff(np.append(starts, len(flat)))), pa.array(flat.astype(np.int32)))
            absent = np.bincount(text[~there], minlength=len(split))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, rare, pa.array(absent)], ["id", "key", "ids", "rare", "absent"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, key long, ids array<int>, rare array<binary>, absent long")


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of lists, and where each list starts."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets[:-1] - offsets[0]


def count_next(tokens: DataFrame, tree: Tree, depth: int) -> DataFrame:
    """Column ids -> (code, c): code is node x width + id of the next token, for the nodes of one depth."""
    shared = tokens.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        low, high = model.depth_of(depth)
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            code, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(c)], ["code", "c"])

        for batch in slices(batches):
            flat, starts = _flat(batch.column(0))
            node = model.longest(flat, starts, depth)
            at = (node >= low) & (node < high)
            held.append(node[at] * model.width + flat[at])
            size += len(held[-1])
            if size > FLUSH_TOKENS:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return tokens.select("ids").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, *, text_col: str = "text") -> tuple[Tree, DataFrame]:
    """The tree of the given texts, and the table of all their words (word, c)."""
    tree, words = root_of(docs, text_col=text_col)
    grow(tree, stored(tokenize(docs, tree.words, words, id_col=text_col, text_col=text_col).select("ids"), "tokens"))
    return tree, words


def root_of(docs: DataFrame, *, text_col: str = "text") -> tuple[Tree, DataFrame]:
    """A tree of the root alone, with the words that may be named, and the table of all words."""
    words = stored(count_words(docs.select(utf8(F.col(text_col)).alias("body"))), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    heavy = words.where(F.col("c") >= min(n * P_WORD, named_least(n))).orderBy(F.desc("c"), "word").toPandas()
    return Tree([bytes(w) for w in heavy["word"]], heavy["c"].to_numpy(np.int64), n, v), words


def named_least(n: int) -> float:
    return max(LEAST_NEXT, n**0.5 / NEXTS)


def grow(tree: Tree, tokens: DataFrame) -> None:
    """Adds the nodes of a training part's tokens (ids) to a root."""
    n = tree.n
    least = max(LEAST_CONTEXT, n**0.5 / CONTEXTS)
    width, totals = tree.width, np.empty(0)
    frequent = np.flatnonzero(tree.counts >= least)  # contexts of one token, as (root, word)
    end = next((i for i, w in enumerate(tree.words) if w == END), -1)
    frequent = frequent[frequent != end]
    keys, total, suffixes = frequent.astype(np.int64), tree.counts[frequent], np.full(len(frequent), -1, np.int64)
    named: dict[str, list[np.ndarray]] = {"code": [], "c": []}
    for depth in range(1, DEPTH + 1):
        if not len(keys):
            break
        order = np.argsort(keys)
        first = len(tree.suffix)
        tree.keys.append(keys[order])
        tree.nodes.append(first + np.arange(len(keys)))
        tree.suffix = np.concatenate((tree.suffix, suffixes[order]))
        totals = np.concatenate((totals, total[order]))
        counts = count_next(tokens, tree, depth).where((F.col("c") >= named_least(n)) & (F.col("code") % width < width - 1))
        kept = counts.toPandas()
        code, c = kept["code"].to_numpy(np.int64), kept["c"].to_numpy(np.int64)
        named["code"].append(code)
        named["c"].append(c)
        if depth == DEPTH:
            break
        # a context one longer: this node's tokens and the next one; its suffix node drops the oldest token
        more = (c >= least) & (code % width != end)
        older = _words_of(tree, code[more] // width, depth)
        shorter = _node_of(tree, np.column_stack((older[:, 1:], code[more] % width)))
        ok = shorter >= 0
        keys, total, suffixes = (shorter[ok] + 1) * width + older[ok, 0], c[more][ok], shorter[ok]
    _finish(tree, np.concatenate(named["code"] or [np.empty(0, np.int64)]), np.concatenate(named["c"] or [np.empty(0, np.int64)]), totals)


def _words_of(tree: Tree, nodes: np.ndarray, depth: int) -> np.ndarray:
    """The tokens of nodes of one depth, the oldest first."""
    out = np.empty((len(nodes), depth), np.int64)
    for d in range(depth, 0, -1):
        key = tree.keys[d - 1][nodes - tree.depth_of(d)[0]]
        out[:, depth - d] = key % tree.width
        nodes = key // tree.width - 1
    return out


def _node_of(tree: Tree, words: np.ndarray) -> np.ndarray:
    """The nodes of contexts, the oldest token first; -1 where there is none."""
    node, ok = np.full(len(words), -1, np.int64), np.ones(len(words), bool)
    for d in range(words.shape[1]):
        key = (node + 1) * tree.width + words[:, -1 - d]
        slot = np.searchsorted(tree.keys[d], key)
        slot[slot == len(tree.keys[d])] = 0
        ok &= (tree.keys[d][slot] == key) if len(tree.keys[d]) else False
        node = np.where(ok, tree.nodes[d][slot] if len(tree.nodes[d]) else -1, -1)
    return node


def _finish(tree: Tree, code: np.ndarray, c: np.ndarray, totals: np.ndarray) -> None:
    """Smooth the nodes from the shortest on and retain those that diverge from the state that their suffix has."""
    nodes = len(tree.suffix)
    tree.state, tree.log_rest = np.full(nodes, -1, np.int64), np.zeros(nodes)
    order = np.argsort(code)
    code, c = code[order], c[order]
    log = np.zeros(len(code))
    node, word = code // tree.width, code % tree.width
    share = np.maximum(c - DISCOUNT, 0) / totals[node] if nodes else np.empty(0)
    rest = np.clip(1 - np.bincount(node, share, nodes).astype(np.float64), 1e-12, 1) if nodes else np.empty(0)
    root = 10.0 ** tree.root(tree.counts) if len(tree.counts) else np.empty(0)
    for depth in range(1, len(tree.nodes) + 1):
        low, high = tree.depth_of(depth)
        a, b = np.searchsorted(code, [low * tree.width, high * tree.width])
        up = tree.suffix[node[a:b]]
        state = np.where(up >= 0, tree.state[up], -1) if depth > 1 else up
        before, weight, open_ = np.zeros(b - a), np.ones(b - a), np.arange(b - a)
        while len(open_):
            at_root = state[open_] < 0
            before[open_[at_root]] = weight[open_[at_root]] * root[word[a:b][open_[at_root]]]
            open_ = open_[~at_root]
            key = state[open_] * tree.width + word[a:b][open_]
            slot = np.searchsorted(code, key)
            slot[slot == len(code)] = 0
            found = code[slot] == key if len(code) else np.zeros(len(open_), bool)
            before[open_[found]] = weight[open_[found]] * 10.0 ** log[slot[found]]
            open_ = open_[~found]
            weight[open_] *= rest[state[open_]]
            higher = tree.suffix[state[open_]]
            state[open_] = np.where(higher >= 0, tree.state[higher], -1)
        p = c[a:b] / totals[node[a:b]]
        at = node[a:b] - low
        gain = np.bincount(at, p * np.log(p / before), high - low).astype(np.float64)
        p_rest = np.clip(1 - np.bincount(at, p, high - low), 0, 1)
        q_rest = np.clip(1 - np.bincount(at, before, high - low), 1e-12, 1)
        gain += np.where(p_rest > 0, p_rest * np.log(np.maximum(p_rest, 1e-300) / q_rest), 0)
        keep = totals[low:high] * gain > DIVERGENCE * np.log(max(2, tree.n))
        parents = tree.suffix[low:high]
        fallback = np.where(parents >= 0, tree.state[parents], -1)
        tree.state[low:high] = np.where(keep, np.arange(low, high), fallback)
        log[a:b] = np.log10(share[a:b] + rest[node[a:b]] * before)
    kept = tree.state[node] == node if nodes else np.empty(0, bool)
    tree.named, tree.named_log = code[kept], log[kept]
    tree.log_rest = np.log10(rest) if nodes else np.empty(0)


def score(docs: DataFrame, tree: Tree, words: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of every document."""
    tokens = stored(tokenize(docs, tree.words, words, id_col=id_col, text_col=text_col), "tokens")
    return score_tokens(tokens, tree, words).withColumnRenamed("id", id_col)


def score_tokens(tokens: DataFrame, tree: Tree, words: DataFrame) -> DataFrame:
    """As score, of a table that tokenize has made."""
    shared = tokens.sparkSession.sparkContext.broadcast(tree)
    names = ["id", "key", "n_tokens", "known", "base", "model"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        root = np.append(model.root(model.counts), 0.0)
        nothing = float(model.root(np.zeros(1))[0])
        for batch in slices(batches):
            flat, starts = _flat(batch.column(2))
            absent = batch.column(3).to_numpy()
            known, base, score = (np.add.reduceat(x, starts) if len(starts) else x for x in ((flat < len(model.words)) * 1, root[flat], model.log_probability(flat, starts)))
            sizes = np.diff(np.append(starts, len(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (sizes, known, base + absent * nothing, score + absent * nothing))], names)

    kind = dict(tokens.dtypes)["id"]
    parts = tokens.select("id", "key", "ids", "absent").mapInArrow(run, f"id {kind}, key long, n_tokens long, known long, base double, model double")
    seen = tokens.select("key", F.posexplode("rare").alias("nth", "word")).join(words, "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(tree.n + tree.v + 1)))
    sums = seen.groupBy("key").agg((F.sum(log) / F.count_if(F.col("nth") == 0)).alias("rare_log"), (F.count("c") / F.count_if(F.col("nth") == 0)).cast("long").alias("rare_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.join(sums, "key", "left").select(
        "id", "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"), (F.col("base") + zero("rare_log")).alias("base_score"), (F.col("model") + zero("rare_log")).alias("score")
    )


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), MODULUS) == HELD
    tree, words = root_of(docs.where(~held))
    tokens = stored(tokenize(docs, tree.words, words), "tokens").withColumn("held_out", remainder(F.col("id"), MODULUS) == HELD)
    grow(tree, tokens.where("NOT held_out"))
    found = score_tokens(tokens, tree, words).withColumnRenamed("id", "doc_id")
    return found.withColumns({"held_out": held, "train_tokens": F.lit(tree.n).cast("long")}).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_suffix_tree": op8_suffix_tree}
ORACLES: dict[str, str] = {}
