import math
import zlib
from collections import Counter

import numpy as np

from payloom.llm import suffix_tree as S
from tests.llm.conftest import make_docs


def tokens(t):
    return (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split() + [b"\n"]


def test_edges_and_base(spark, edge_docs, edge_rows, no_docs):
    tree, words = S.train(edge_docs)
    count = Counter(w for _, t in edge_rows for w in tokens(t))
    assert {bytes(r["word"]): r["c"] for r in words.collect()} == count
    n, v = sum(count.values()), len(count)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in S.score(edge_docs, tree, words).collect()), key=str)
    want = [(i, len(tokens(t)), len(tokens(t)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in edge_rows]
    assert got == sorted(want, key=str)
    assert S.score(no_docs, tree, words).count() == 0
    tree, words = S.train(no_docs)
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in S.score(edge_docs, tree, words).collect())


def test_rare_words_give_the_same_base(spark, edge_docs, monkeypatch):
    key = lambda rows: sorted(((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in rows), key=str)
    whole = key(S.score(edge_docs, *S.train(edge_docs)).collect())
    monkeypatch.setattr(S, "P_WORD", 0.01)
    monkeypatch.setattr(S, "NEXTS", 0.5)
    tree, words = S.train(edge_docs)
    assert len(tree.words) < words.count()
    assert key(S.score(edge_docs, tree, words).collect()) == whole


def test_states_are_distributions_and_longest_suffixes_count(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_CONTEXT", 200)
    text = " ".join("a b c a b d x b e".split() * 400)
    docs = make_docs(spark, [(i, text) for i in range(4)] + [(9, "q r s")])
    tree, words = S.train(docs)
    ids = {w: i for i, w in enumerate(tree.words)}
    retained = {tuple(tree.words[j] for j in S._words_of(tree, np.array([k]), d)[0]) for d in range(1, len(tree.nodes) + 1) for k in range(*tree.depth_of(d)) if tree.state[k] == k}
    assert (b"x", b"b") in retained and (b"b",) in retained
    every = np.arange(len(tree.words))

    def following(*context):
        flat = np.concatenate([[*[ids[c] for c in context], w] for w in every])
        starts = np.arange(len(every)) * (len(context) + 1)
        return 10 ** tree.log_probability(flat, starts)[len(context) :: len(context) + 1]

    unseen = 1 / (tree.n + tree.v + 1)
    for context in ((b"x", b"b"), (b"b",), (b"a",), (b"q",), (b"s", b"x")):
        p = following(*context)
        assert unseen * 0 < 1 - p.sum() < 1e-3 or abs(p.sum() - 1) < 1e-9
    assert following(b"x", b"b")[ids[b"e"]] > 0.99 and following(b"c", b"a")[ids[b"b"]] > 0.99
    rows = {r["doc_id"]: r for r in S.score(docs, tree, words).collect()}
    assert rows[0]["score"] > rows[0]["base_score"] * 0.5


def test_model_beats_base_on_held_out_rows(spark):
    rows = S.op8_suffix_tree(spark, "/root/testdata/sf0.01").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 7 == 2 for i in rows["doc_id"]]).all()
    out = rows[rows["held_out"]]
    assert out["score"].sum() > out["base_score"].sum()


class Plain:
    """The model by explicit counts, one context at a time."""

    def __init__(self, texts, least, named_least):
        self.c = Counter(w for t in texts for w in tokens(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        follow = {}
        for t in texts:
            w = tokens(t)
            for i in range(len(w)):
                for d in range(1, min(i, S.DEPTH) + 1):
                    follow.setdefault(tuple(w[i - d : i]), Counter())[w[i]] += 1
        self.nodes = {}
        for context in sorted(follow, key=len):
            if sum(follow[context].values()) >= least and (len(context) == 1 or context[1:] in self.nodes and context[:-1] in self.nodes):
                self.nodes[context] = ({w: k for w, k in follow[context].items() if k >= named_least}, sum(follow[context].values()))
        self.state = {(): ()}
        for context in sorted(self.nodes, key=len):
            named, total = self.nodes[context]
            before = {w: self.p(self.state[context[1:]], w) for w in named}
            gain = sum(k / total * math.log(k / total / before[w]) for w, k in named.items())
            rest, other = 1 - sum(named.values()) / total, max(1e-12, 1 - sum(before.values()))
            gain += rest * math.log(rest / other) if rest > 1e-15 else 0
            self.state[context] = context if total * gain > S.DIVERGENCE * math.log(self.n) else self.state[context[1:]]

    def p(self, state, w):
        if not state:
            return (self.c[w] + 1) / (self.n + self.v + 1)
        named, total = self.nodes[state]
        rest = max(1e-12, 1 - sum(max(k - S.DISCOUNT, 0) / total for k in named.values()))
        return max(named.get(w, 0) - S.DISCOUNT, 0) / total + rest * self.p(self.state[state[1:]], w)

    def score(self, text):
        w, out = tokens(text), 0.0
        for i in range(len(w)):
            context = ()
            for d in range(1, min(i, S.DEPTH) + 1):
                if tuple(w[i - d : i]) not in self.nodes:
                    break
                context = tuple(w[i - d : i])
            out += math.log10(self.p(self.state[context], w[i]))
        return out


def test_scores_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_CONTEXT", 12)
    monkeypatch.setattr(S, "LEAST_NEXT", 3)
    rng = np.random.default_rng(5)
    phrases = ["the cat sat on the mat", "a dog ran to the big red house", "Rain falls", "x y z x y z w"]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.7 else f"w{rng.integers(40)}" for _ in range(rng.integers(0, 12))) for _ in range(150)] + [None, "", "rare words only here"]
    extra = ["the cat sat on unseen words", "never seen", "x y z w " * 5, None]
    docs = make_docs(spark, list(enumerate(texts + extra)))
    tree, words = S.train(docs.where(f"doc_id < {len(texts)}"))
    plain = Plain(texts, 12, 3)
    assert {len(k) for k, v in plain.state.items() if v == k and k} >= {1, 2, 4}
    for r in S.score(docs, tree, words).collect():
        assert abs(r["score"] - plain.score((texts + extra)[r["doc_id"]])) < 1e-6


def test_tree_grows_with_its_input(spark):
    """Four times the text: more nodes and more named tokens."""
    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(400)])
    share = 1 / np.arange(1, 401)
    texts = [" ".join(rng.choice(words, 300, p=share / share.sum())) for _ in range(200)]
    sizes = []
    for part in (texts[:50], texts):
        tree, _ = S.train(make_docs(spark, list(enumerate(part))))
        sizes.append((sum(map(len, tree.nodes)), len(tree.words)))
    assert sizes[1][0] > 1.3 * sizes[0][0]
