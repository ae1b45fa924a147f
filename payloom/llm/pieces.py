"""N-best segmentation over a piece lattice: forward Viterbi, backward A-star.

A text is normalised as the piece file says (a space in front, spaces become U+2581) and every piece of the file that
occurs in it is an edge of a lattice. A segmentation's score is the sum of its pieces' scores; a character that no
piece covers is an edge of `UNKNOWN` less than the lowest normal score, decoded through byte pieces. Segmentations
are ordered by score, then fewer pieces, then the smaller ids, compared from the last piece backwards.

Forward Viterbi keys (cost, pieces) from the left end are exact for every prefix, so a backward A-star search from the
right end that adds them to the cost of a suffix takes complete segmentations off its queue in that order, no other.
Suffixes of equal keys are followed depth first by their ids; each is a link to the one that it extends, and suffixes
that can't be among the n best any more aren't queued, so a long word takes memory in proportion to its length.

No piece reaches over a space that follows another character, so the lattice is a chain of words; words of over `LONG`
characters are parted further wherever no piece that occurs in them reaches over, as in text without spaces. A worker remembers the
best segmentation and the distance of the second of `CACHE_WORDS` words before it forgets the rarer ones, found for all new words of a
slice at once by forward and backward Viterbi passes in numpy (for words that stay long, by the search itself). The n best of a whole text differ from the best in at
most n-1 words, which the distances name; only those words are searched, no farther than the n-th best can be, and their lists are merged exactly.

Defined results: null and empty texts have no pieces, one empty segmentation of score 0, and decode to the empty text;
a text has fewer than n segmentations if there are no more; repeated rows each get their row. Decoding gives the text
back, but U+2581 comes back as a space. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom.llm.common import slices, table

MODEL = "piece_bpe_32k.model"
N_BEST = 4
UNKNOWN = 10
SPACE = "▁"
CACHE_WORDS = 600_000
#: Words whose n best segmentations a worker remembers.
CACHE_LISTS = 25_000
#: Longer words are searched by themselves, not in numpy with others.
LONG = 48
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
INF = 1 << 60
#: Bits of a search's key that count pieces.
PIECES = 32
#: Words solved at once in numpy.
TOGETHER = 1024
NONE = INF * 2048.0
#: In numpy a key is cost * BIG + pieces, so that one minimum orders both; NO_KEY: of no edge or path.
BIG = 1 << 12
NO_KEY = 1 << 61

Key = tuple[int, int]
Path = tuple[int, int, tuple[int, ...]]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_of(name: str) -> str:
    """The word that words() names so."""
    return name[1:] if name[0] == " " else SPACE + name


class Lattice:
    """The pieces of a file and the search over them."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(len(model))]
        kinds = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(model))]
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(self.names) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown_id = model.unk_id()
        self.cost = {n: (i, round(-model.get_score(i))) for i, (n, special) in enumerate(zip(self.names, kinds, strict=True)) if not special}
        self.unknown_cost = max(c for _, c in self.cost.values() if c < 1_000_000) + UNKNOWN
        self.key = {n: (i, (c << PIECES) + 1) for n, (i, c) in self.cost.items()}
        self.longest = max(map(len, self.cost))
        self.length = np.array([len(n) for n in self.names], np.int64)
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]
        self.raw_size = np.array([len(r) for r in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_pool = np.frombuffer(b"".join(self.raw), np.uint8)
        self.cache_words = cache_words
        self._codes()
        self.reset()

    def reset(self) -> None:
        """Forget all words. A word's place leads to the cost, pieces and ids of its best segmentation and how far off the second is."""
        self.place: dict[str, int] = {}
        self.costs, self.counts, self.extra = array("q"), array("q"), array("d")
        self.starts, self.sizes, self.pool = array("q"), array("q"), array("i")
        self.seen = np.zeros(0, np.int64)
        self.lists: dict[tuple[str, int], tuple[int | None, list[Path]]] = {}

    def shrink(self) -> None:
        """Keep the words that came most often, half of the cache at most and none that came once."""
        half = self.cache_words // 2
        seen = np.pad(self.seen, (0, len(self.costs) - len(self.seen)))
        stays = seen > (max(1, np.partition(seen, -half - 1)[-half - 1]) if len(seen) > half else 1)
        words = [word for word, stay in zip(self.place, stays.tolist(), strict=True) if stay]
        kept, lists = [np.array(x)[stays] for x in (self.costs, self.counts, self.extra, self.starts, self.sizes)], self.lists
        pool, before = np.array(self.pool), np.cumsum(kept[4])
        if len(before) and before[-1] > 8 * self.cache_words:
            return self.reset()
        ids = pool[np.repeat(kept[3] - before + kept[4], kept[4]) + np.arange(before[-1] if len(before) else 0)]
        self.reset()
        self.lists = lists
        self.place.update(zip(words, range(len(words)), strict=True))
        kept[3] = before - kept[4]
        for x, new in zip((self.costs, self.counts, self.extra, self.starts, self.sizes, self.pool), (*kept, ids), strict=True):
            x.frombytes(new.tobytes())

    def _keep(self, word: str, cost: int, pieces: int, tail: tuple[int, ...], more_cost: int, more_pieces: int) -> None:
        self.place[word] = len(self.costs)
        self.costs.append(cost)
        self.counts.append(pieces)
        self.extra.append(more_cost * 4096.0 + more_pieces)
        self.starts.append(len(self.pool))
        self.pool.extend(self.to_ids([tail]))
        self.sizes.append(len(self.pool) - self.starts[-1])

    # --- one word, by the method itself

    def edges(self, word: str, end: int) -> list[tuple[int, int, int]]:
        """(start, id, cost) of the edges that end at a place; an unknown character's id is -1 - its code point."""
        piece = self.cost.get
        found = [(start, got[0], got[1]) for start in range(max(0, end - self.longest), end) if (got := piece(word[start:end]))]
        if not found or found[-1][0] != end - 1:
            found.append((end - 1, -1 - ord(word[end - 1]), self.unknown_cost))
        return found

    def forward(self, word: str, edges: list[list[tuple[int, int, int]]] | None = None) -> list[Key]:
        """The least (cost, pieces) of each prefix."""
        best: list[Key] = [(0, 0)]
        for steps in edges or self.all_edges(word):
            best.append(min([(best[start][0] + cost, best[start][1] + 1) for start, _, cost in steps]))
        return best

    def all_edges(self, word: str) -> list[list[tuple[int, int, int]]]:
        return [self.edges(word, end) for end in range(1, len(word) + 1)]

    def n_best(self, word: str, n: int, over: int | None = None) -> list[Path]:
        """The n first segmentations of a word as (cost, pieces, ids from the last to the first); those that cost at most `over` more than the first, if given."""
        # a key is cost << PIECES | pieces, so that keys are added and compared as one number
        edges: list[list[tuple[int, int, int]]] = []
        prefix, piece = [0], self.key.get
        for end in range(1, len(word) + 1):
            steps, best = [], INF << PIECES
            for start in range(max(0, end - self.longest), end):
                if got := piece(word[start:end]):
                    name, step = got
                    steps.append((start, name, step))
                    if prefix[start] + step < best:
                        best = prefix[start] + step
            if not steps or steps[-1][0] != end - 1:
                step = (self.unknown_cost << PIECES) + 1
                steps.append((end - 1, -1 - ord(word[end - 1]), step))
                best = min(best, prefix[-1] + step)
            edges.append(steps)
            prefix.append(best)
        # a suffix: (the one it extends, its first piece's id, where it begins, its key)
        queue: list[tuple[int, int, tuple]] = [(prefix[-1], 0, (None, 0, len(word), 0))]
        top = prefix[-1] + (over + 1 << PIECES) if over is not None else INF << PIECES
        least: list[int] = []  # the n smallest keys queued so far, negated: each is a segmentation's
        out: list[Path] = []
        count = 0
        while queue and len(out) < n:
            key, open_ = queue[0][0], []
            while queue and queue[0][0] == key:
                open_.append(heapq.heappop(queue)[2])
            if len(open_) > 1:
                open_ = heapq.nsmallest(n - len(out), open_, key=self._tail)
            open_.reverse()
            while open_ and len(out) < n:
                suffix = open_.pop()
                _, _, at, spent = suffix
                if at == 0:
                    out.append((key >> PIECES, key & (1 << PIECES) - 1, self._tail(suffix)))
                    continue
                same = []
                for start, name, step in edges[at - 1]:
                    so_far = spent + step
                    more = prefix[start] + so_far
                    if more == key:
                        same.append((suffix, name, start, so_far))
                    elif more < top:
                        if len(least) < n:
                            heapq.heappush(least, -more)
                        elif more <= -least[0]:
                            heapq.heapreplace(least, -more)
                        else:
                            continue
                        count += 1
                        heapq.heappush(queue, (more, count, (suffix, name, start, so_far)))
                if len(same) > 1:
                    same.sort(key=itemgetter(1), reverse=True)
                open_ += same
        return out

    @staticmethod
    def _tail(suffix: tuple) -> tuple[int, ...]:
        """The ids of a suffix from the last piece to the first."""
        out = []
        while suffix[0] is not None:
            out.append(suffix[1])
            suffix = suffix[0]
        return tuple(reversed(out))

    def parts(self, word: str) -> list[str]:
        """A long word cut wherever no piece that occurs in it reaches over."""
        if len(word) <= LONG:
            return [word]
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, h = len(chars), np.ones(len(chars), np.uint64)
        over = np.zeros(n + 1, np.int64)
        with np.errstate(over="ignore"):
            for length in range(1, min(self.longest, n) + 1):
                h = self._mix(h[: n - length + 1], chars[length - 1 :])
                at = np.flatnonzero(self._look_up(h) >= 0) if length > 1 else np.empty(0, np.int64)
                np.add.at(over, at + 1, 1)
                np.add.at(over, at + length, -1)
        cuts = np.flatnonzero(np.cumsum(over)[1:n] == 0) + 1
        return [word[a:b] for a, b in pairwise([0, *cuts.tolist(), n])]

    # --- many words at once

    def _codes(self) -> None:
        """Each piece as a hash of its characters, in order, for look-ups in numpy."""
        pieces = list(self.cost)
        codes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        if (np.diff(self.codes.astype(object)) == 0).any():
            raise ValueError("two pieces have one hash")
        self.code_id = np.array([self.cost[p][0] for p in pieces], np.int64)[order]
        self.code_cost = np.array([self.cost[p][1] for p in pieces], np.int64)[order]
        top = np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)
        self.first = np.append(np.searchsorted(self.codes, top), len(self.codes))
        self.probes = int(np.diff(self.first).max())
        self.used = np.diff(self.first) > 0
        # of a slot's piece, and at -1 of none
        self.slot_key = np.append(self.code_cost * BIG + 1, NO_KEY)
        self.slot_id = np.append(self.code_id, -1).astype(np.int32)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Where the pieces with these hashes are; -1: nowhere."""
        flat = h.ravel()
        top = (flat >> np.uint64(44)).astype(np.int64)
        out = np.full(len(flat), -1, np.int64)
        may = np.flatnonzero(self.used[top])
        at, want = self.first[top[may]], flat[may]
        for _ in range(self.probes):
            inside = np.minimum(at, len(self.codes) - 1)
            hit = self.codes[inside] == want
            out[may[hit]] = inside[hit]
            at = at + 1
        return out.reshape(h.shape)

    @staticmethod
    def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def _hash(self, s: str) -> int:
        h = np.array([1], np.uint64)
        with np.errstate(over="ignore"):
            for c in s:
                h = self._mix(h, np.array([ord(c)], np.uint64))
        return int(h[0])

    def solve(self, words: list[str]) -> list[tuple[int, int, tuple[int, ...], int, int]]:
        """For each short word: cost, pieces, ids (last first) of the best segmentation; extra cost and pieces of the second (INF: none)."""
        cost, pieces, more_cost, more_pieces, of, ids = self._solve(words)
        tails = np.split(ids[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(words)))[:-1])
        return [(c, p, tuple(t.tolist()), a, b) for c, p, t, a, b in zip(cost.tolist(), pieces.tolist(), tails, more_cost.tolist(), more_pieces.tolist(), strict=True)]

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As solve, in arrays: cost, pieces, extra cost, extra pieces of each word; the word and the id of each piece, last pieces first."""
        count, width = len(words), max(map(len, words))
        size = np.fromiter(map(len, words), np.int64, count)
        chars = np.zeros((width, count), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.repeat(np.arange(count), size)
        chars[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), rows] = flat
        big, none = BIG, NO_KEY
        most = min(self.longest, width)
        key = np.full((width + 1, most + 1, count), none, np.int64)  # [end, length, word]
        name = np.full((width + 1, most + 1, count), -1, np.int32)
        h = np.ones((width, count), np.uint64)
        with np.errstate(over="ignore"):
            for length in range(1, most + 1):
                starts = width - length + 1
                h = self._mix(h[:starts], chars[length - 1 : length - 1 + starts])
                slot = self._look_up(h)
                key[length:, length] = self.slot_key[slot]
                name[length:, length] = self.slot_id[slot]
        for end in range(1, width + 1):
            lost = (key[end, 1] == none) & (size >= end)
            key[end, 1, lost] = self.unknown_cost * big + 1
            name[end, 1, lost] = -1 - chars[end - 1, lost].astype(np.int64)
        # forward: the best of each prefix, and of its last edges the one with the smallest id
        left, last = np.zeros((width + 1, count), np.int64), np.zeros((width + 1, count), np.int32)
        for end in range(1, width + 1):
            m = min(most, end)
            through = left[end - m : end][::-1] + key[end, 1 : m + 1]
            best = through.min(axis=0)
            last[end] = np.where(through == best, name[end, 1 : m + 1], np.iinfo(np.int32).max).min(axis=0)
            np.minimum(best, none, out=left[end])
        right = np.full((width + 1, count), none, np.int64)
        right[size, np.arange(count)] = 0
        for end in range(width, 0, -1):
            m = min(most, end)
            before = right[end - m : end][::-1]
            np.minimum(before, key[end, 1 : m + 1] + right[end], out=before)
        total = left[size, np.arange(count)]
        # from the end, the best edges; on_path: their lengths
        at, of, ids, on_path = size.copy(), [], [], np.zeros((width + 1, count), np.int64)
        while len(open_ := np.flatnonzero(at)):
            ids.append(last[at[open_], open_])
            of.append(open_)
            length = np.where(ids[-1] < 0, 1, self.length[ids[-1]])
            on_path[at[open_], open_] = length
            at[open_] -= length
        second = np.full(count, none, np.int64)
        for end in range(1, width + 1):
            m = min(most, end)
            through = left[end - m : end][::-1] + key[end, 1 : m + 1]
            through += right[end]
            here = np.flatnonzero(on_path[end])
            through[on_path[end, here] - 1, here] = none
            np.minimum(second, through.min(axis=0), out=second)
        alone = second >= none
        more_cost = np.where(alone, INF, second // big - total // big)
        more_pieces = np.where(alone, 0, second % big - total % big)
        return total // big, total % big, more_cost, more_pieces, np.concatenate(of), np.concatenate(ids)

    def learn(self, words: set[str]) -> None:
        """Solve the words, given by their names, that aren't known yet."""
        if len(self.place) > self.cache_words or len(self.pool) > 16 * self.cache_words:
            self.shrink()
        new = sorted(words - self.place.keys(), key=len)
        short = [w for w in new if len(word_of(w)) <= LONG]
        for at in range(0, len(short), TOGETHER):
            self._learn_short(short[at : at + TOGETHER])
        for w in sorted(set(new) - set(short)):
            paths = self.n_best(word_of(w), 2)
            more = (paths[1][0] - paths[0][0], paths[1][1] - paths[0][1]) if len(paths) > 1 else (INF, 0)
            self._keep(w, *paths[0], *more)

    def _learn_short(self, words: list[str]) -> None:
        cost, pieces, more_cost, more_pieces, of, ids = self._solve(list(map(word_of, words)))
        order = np.argsort(of[::-1], kind="stable")
        of, ids = of[::-1][order], ids[::-1][order]
        sizes = np.bincount(of, minlength=len(words))
        if (ids < 0).any():  # characters without a piece become byte pieces
            lost = ids < 0
            width = np.ones(len(ids), np.int64)
            found = [self.to_ids([(i,)]) for i in ids[lost].tolist()]
            width[lost] = [len(f) for f in found]
            spread = np.repeat(ids, width)
            spread[np.repeat(lost, width)] = [i for f in found for i in f]
            sizes, ids = np.bincount(of, width, len(words)).astype(np.int64), spread
        first = len(self.costs)
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        self.costs.frombytes(cost.astype(np.int64).tobytes())
        self.counts.frombytes(pieces.astype(np.int64).tobytes())
        self.extra.frombytes((more_cost * 4096.0 + more_pieces).tobytes())
        self.starts.frombytes((len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.pool.frombytes(ids.astype(np.int32).tobytes())

    def word_list(self, word: str, n: int, over: int | None = None) -> list[Path]:
        """As n_best, of a word by its name; there may be some that cost more."""
        known, got = self.lists.get((word, n), (-1, []))
        if known is not None and (over is None or over > known):
            if len(self.lists) > CACHE_LISTS:
                self.lists.clear()
            over = over if over is None else (1 << over.bit_length()) - 1  # so that few words are searched again
            got = self.n_best(word_of(word), n, over)
            self.lists[word, n] = over, got
        return got

    # --- whole texts

    def words(self, text: str | None) -> list[str]:
        """Names of a text's words: a word that has one space in front by what follows it, others by a space and the word."""
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
            names = text.split(" ")
            if max(map(len, names)) < LONG:
                return names
        words = _WORDS(SPACE + text.replace(" ", SPACE))
        if max(map(len, words)) > LONG:
            words = [p for w in words for p in self.parts(w)]
        return [w[1:] if w[0] == SPACE and w[1:2] not in ("", SPACE) else " " + w for w in words]

    def search(self, words: list[str], extra: np.ndarray, n: int) -> list[tuple[int, int, dict[int, tuple[int, ...]]]]:
        """The n best of a chain of known words: cost and pieces over the best, and ids (last first) of the words that differ from it."""
        if n == 1 or not words:
            return [(0, 0, {})]
        kth = min(n - 2, len(words) - 1)
        limit = np.partition(extra, kth)[kth]
        near = np.flatnonzero((extra <= limit) & (extra < NONE))
        # n - 1 words have a second segmentation that is as near as limit: none of the n best is farther
        over = int(limit // 4096) + 1 if kth == n - 2 and limit < NONE else None
        if len(near) > n - 1:  # ties: a deviation that is smaller from the end comes first if it is later, else if it is earlier
            under = [i for i in near.tolist() if extra[i] < limit]
            tied = [i for i in near.tolist() if extra[i] == limit]
            smaller = {i for i in tied if (two := self.word_list(words[i], n, over))[1][2] < two[0][2]}
            tied = sorted(smaller, reverse=True) + [i for i in tied if i not in smaller]
            near = np.array(sorted(under + tied[: n - 1 - len(under)]))
        # exact merge over the chosen words, from the first to the last
        partial: list[tuple[int, int, tuple]] = [(0, 0, ())]
        for i in near.tolist():
            options = self.word_list(words[i], n, over)
            best = options[0]
            partial = heapq.nsmallest(n, ((a + c - best[0], b + p - best[1], (ids, *chosen)) for a, b, chosen in partial for c, p, ids in options))
        order = near.tolist()[::-1]
        return [(a, b, dict(zip(order, chosen, strict=True))) for a, b, chosen in partial]

    def to_ids(self, tails: list[tuple[int, ...]]) -> list[int]:
        """Ids in order of words given last piece first; unknown characters become byte pieces."""
        out: list[int] = []
        for tail in tails:
            for i in reversed(tail):
                if i >= 0:
                    out.append(i)
                else:
                    out += [self.bytes.get(b, self.unknown_id) for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def encode(self, text: str | None, n: int = N_BEST) -> list[tuple[int, list[int]]]:
        """(score, ids) of the n best segmentations of a text."""
        words = self.words(text)
        self.learn(set(words))
        places = [self.place[w] for w in words]
        cost = sum(self.costs[k] for k in places)
        own = [self.pool[self.starts[k] : self.starts[k] + self.sizes[k]].tolist() for k in places]
        out = []
        for more, _, other in self.search(words, np.array([self.extra[k] for k in places]), n):
            parts = [self.to_ids([other[i]]) if i in other else ids for i, ids in enumerate(own)]
            out.append((-cost - more, [i for part in parts for i in part]))
        return out

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and how many each has."""
        size = self.raw_size[ids]
        before = np.cumsum(size) - size
        return self.raw_pool[np.repeat(self.raw_start[ids] - before, size) + np.arange(int(size.sum()))], size

    def batch(self, texts: list[str | None], n: int) -> list[tuple[int, int, int, list[int], list[int], list[int], bool]]:
        """Of each text: pieces and crc32 of the best ids (little-endian unsigned 32-bit), number of segmentations, their scores, pieces and crc32s,
        whether decoding each of them gives the text back."""
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        ends = np.cumsum([len(words) for words in split])
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, ends[-1] if len(ends) else 0)
        self.seen = np.bincount(place, minlength=len(self.costs)) + np.pad(self.seen, (0, len(self.costs) - len(self.seen)))
        costs, extra, starts, sizes, pool = np.frombuffer(self.costs, np.int64), np.frombuffer(self.extra, np.float64), np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int64), np.frombuffer(self.pool, np.int32)
        cost, extra, size = (x[place] if len(place) else np.empty(0, x.dtype) for x in (costs, extra, sizes))
        before = np.concatenate(([0], np.cumsum(size)))
        ids = pool[np.repeat(starts[place] - before[:-1], size) + np.arange(before[-1])] if before[-1] else np.empty(0, np.int32)
        del costs, starts, sizes, pool
        total, cuts = np.concatenate(([0], np.cumsum(cost)))[ends], before[ends]
        body, widths = self.decode_flat(ids)
        bytes_before = np.concatenate(([0], np.cumsum(widths)))
        byte_cuts, body = bytes_before[cuts], body.tobytes()
        raw, out, at, was, byte_at, spent = memoryview(ids.astype("<u4").tobytes()), [], 0, 0, 0, 0
        for text, words, end, cut, byte_cut, sum_ in zip(texts, split, ends.tolist(), cuts.tolist(), byte_cuts.tolist(), total.tolist(), strict=True):
            want = (text or "").replace(SPACE, " ").encode("utf-8", "surrogatepass")
            scores, counts, sums, back = [], [], [], True
            for more, _, other in self.search(words, extra[at:end], n):
                count, crc, id_at, decoded, text_at = cut - was, 0, was, [], byte_at
                for i in sorted(other):  # what lies between the words that differ is as in the best
                    a, b = int(before[at + i]), int(before[at + i + 1])
                    new = self.to_ids([other[i]])
                    crc = zlib.crc32(array("I", new), zlib.crc32(raw[4 * id_at : 4 * a], crc))
                    decoded += [body[text_at : int(bytes_before[a])], *map(self.raw.__getitem__, new)]
                    count, id_at, text_at = count + len(new) - (b - a), b, int(bytes_before[b])
                scores.append(spent - sum_ - more)
                counts.append(count)
                sums.append(zlib.crc32(raw[4 * id_at : 4 * cut], crc))
                back = back and b"".join((*decoded, body[text_at:byte_cut]))[1:] == want
            out.append((counts[0], sums[0], len(scores), scores, counts, sums, back))
            at, was, byte_at, spent = end, cut, byte_cut, sum_
        return out


_LATTICES: dict[str, Lattice] = {}


def lattice_of(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def segmentations(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, n: int = N_BEST) -> DataFrame:
    """id and the n best segmentations (rank, score, ids) of every text."""
    file = model or model_path()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("body"))
    kind = pa.list_(pa.struct([("rank", pa.int32()), ("score", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(file)
        for batch in slices(batches):
            best = [[{"rank": k + 1, "score": s, "ids": ids} for k, (s, ids) in enumerate(lattice.encode(t, n))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, kind)], [id_col, "best"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, best array<struct<rank:int,score:bigint,ids:array<int>>>")


def piece_summary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, n: int = N_BEST) -> DataFrame:
    """id, n_pieces and ids_crc32 of the best, n_best (how many there are of n), scores, pieces and crc32s of each of them, decoded (whether
    decoding each of them gives the text back)."""
    file = model or model_path()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = lattice_of(file).batch
        for batch in slices(batches):
            columns = list(zip(*encode(batch.column(1).to_pylist(), n), strict=True)) or [()] * 7
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int32(), longs, longs, longs, pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n_pieces", "ids_crc32", "n_best", "scores", "pieces", "crc32s", "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, n_pieces long, ids_crc32 long, n_best int, scores array<long>, pieces array<long>, crc32s array<long>, decoded boolean")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_summary(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pieces": op4_pieces}
ORACLES: dict[str, str] = {}
