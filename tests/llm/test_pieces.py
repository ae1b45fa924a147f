import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from payloom.llm import pieces as P


def every(lattice, word):
    out = []

    def go(end, cost, tail):
        if end == 0:
            out.append((cost, len(tail), tail))
        for start, name, step in lattice.edges(word, end) if end else ():
            go(start, cost + step, (*tail, name))

    go(len(word), 0, ())
    return sorted(out)


def test_words_against_all_segmentations():
    lattice, rng = P.Lattice(P.model_path()), random.Random(1)
    words = ["▁" + "".join(rng.choice("abtheinorés☃x") for _ in range(rng.randint(0, 9))) for _ in range(150)]
    for word, got in zip(words, lattice.solve(words), strict=True):
        want = every(lattice, word)
        assert lattice.n_best(word, 4) == want[:4]
        second = (want[1][0] - want[0][0], want[1][1] - want[0][1]) if len(want) > 1 else (P.INF, 0)
        assert got == (*want[0], *second)


def test_texts_against_all_segmentations():
    lattice, rng = P.Lattice(P.model_path()), random.Random(2)
    for _ in range(80):
        text = "".join(rng.choice("ab the☃ ") for _ in range(rng.randint(1, 9)))
        want = every(lattice, "▁" + text.replace(" ", "▁"))[:4]
        assert lattice.encode(text) == [(-c, lattice.to_ids([tail])) for c, _, tail in want]


def test_unbroken_text():
    """Long texts without spaces: the same as their parts one after another, in time."""
    lattice, rng = P.Lattice(P.model_path()), random.Random(4)
    began = time.perf_counter()
    for letters, size in (("的一是不了人我在有他這上個國中文語日本", 200_000), ("x", 20_000), ("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", 50_000), ("アイウかきく漢字ab", 100_000)):
        text = "".join(rng.choice(letters) for _ in range(size))
        best = lattice.encode(text)
        assert len(best) == len({tuple(ids) for _, ids in best}) == (1 if letters[0] == "的" else 4)  # no two of those make a piece
        assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)
        assert all(lattice.decode(ids) == text for _, ids in best)
        parts = [p for w in P._WORDS(P.SPACE + text) for p in lattice.parts(w)]
        assert "".join(parts) == P.SPACE + text
        assert -best[0][0] == sum(lattice.forward(p)[-1][0] for p in parts) == lattice.forward(P.SPACE + text)[-1][0]
    assert time.perf_counter() - began < 60


def test_cut_words_against_all_segmentations(monkeypatch):
    monkeypatch.setattr(P, "LONG", 1)
    lattice, rng = P.Lattice(P.model_path()), random.Random(6)
    for _ in range(80):
        text = "".join(rng.choice("ab的the☃日 ") for _ in range(rng.randint(1, 9)))
        want = every(lattice, "▁" + text.replace(" ", "▁"))[:4]
        assert lattice.encode(text) == [(-c, lattice.to_ids([tail])) for c, _, tail in want]


def test_edges(spark, edge_docs, edge_rows, no_docs):
    rows = P.piece_summary(edge_docs).collect()
    assert len(rows) == len(edge_rows) and all(r["decoded"] for r in rows)
    empty = [r for r in rows if r["doc_id"] == 1][0]
    assert (empty["n_pieces"], empty["n_best"], empty["scores"]) == (0, 1, [0])
    best = {r["doc_id"]: r["best"] for r in P.segmentations(edge_docs.where("doc_id < 8"), n=3).collect()}
    lattice = P.Lattice(P.model_path())
    for i, t in edge_rows:
        if i in best:
            assert all(lattice.decode(b["ids"]) == (t or "").replace("▁", " ") for b in best[i])
            scores = [b["score"] for b in best[i]]
            assert scores == sorted(scores, reverse=True) and len({tuple(b["ids"]) for b in best[i]}) == len(scores)
    assert P.piece_summary(no_docs).count() == 0
    assert [r["scores"] for r in rows if r["doc_id"] == 7][0][:3] == [b["score"] for b in best[7]]


def test_every_segmentation_is_digested(spark, edge_docs, edge_rows):
    """The ids of all n best, not of the best alone, make the summary."""
    lattice = P.Lattice(P.model_path())
    texts = {i: t for i, t in edge_rows if i in (1, 2, 3, 4, 6, 7, 10, 13, 14)}
    for r in P.piece_summary(edge_docs.where(F.col("doc_id").isin(list(texts)))).collect():
        best = [ids for _, ids in lattice.encode(texts[r["doc_id"]])]
        assert r["pieces"] == [len(ids) for ids in best]
        assert r["crc32s"] == [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in best]
        assert (r["n_best"], r["n_pieces"], r["ids_crc32"]) == (len(best), r["pieces"][0], r["crc32s"][0])


def test_each_segmentation_is_decoded(monkeypatch):
    lattice, search = P.Lattice(P.model_path()), P.Lattice.search
    wrong = lambda self, *a: [x if k < 2 else (*x[:2], {i: (5, *ids) for i, ids in x[2].items()}) for k, x in enumerate(search(self, *a))]
    assert lattice.batch(["several words here"], 4)[0][-1]
    monkeypatch.setattr(P.Lattice, "search", wrong)
    assert not lattice.batch(["several words here"], 4)[0][-1]


def test_frequent_words_are_solved_once(monkeypatch):
    """When words are forgotten, the frequent ones stay; the results are those of a lattice that forgets nothing."""
    lattice, whole, rng, solved = P.Lattice(P.model_path(), cache_words=400), P.Lattice(P.model_path()), random.Random(7), []
    solve = P.Lattice._solve
    monkeypatch.setattr(P.Lattice, "_solve", lambda self, words: (solved.extend(words * (self is lattice)), solve(self, words))[1])
    for _ in range(30):
        texts = ["often  " + " ".join("".join(rng.choice("abcde☃") for _ in range(8)) for _ in range(20)) + " often" for _ in range(9)]
        assert lattice.batch(texts, 4) == whole.batch(texts, 4)
        assert len(lattice.place) <= 400 + 200 and len(lattice.place) == len(lattice.costs)
    assert solved.count("▁often") == 1 and len(solved) > 5000


def test_search_ends_at_a_cost():
    lattice, rng = P.Lattice(P.model_path()), random.Random(8)
    for _ in range(100):
        word = "▁" + "".join(rng.choice("abtheinorés☃x") for _ in range(rng.randint(0, 9)))
        want = every(lattice, word)[:4]
        for over in (0, 5, 500, 50_000, 1 << 40):
            assert lattice.n_best(word, 4, over) == [p for p in want if p[0] <= want[0][0] + over]


def test_names_of_words():
    lattice = P.Lattice(P.model_path())
    for text in ("a b", " a", "a ", "a  b", "▁a", "a▁ b", " ", "   ", "x" * 47, "x" * 48, "a " + "的" * 200 + " b", "a\nb\u00a0c d"):
        assert "".join(map(P.word_of, lattice.words(text))) == P.SPACE + text.replace(" ", P.SPACE)
        assert lattice.encode(text)[0][0] == -lattice.forward(P.SPACE + text.replace(" ", P.SPACE))[-1][0]
