import random
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from payloom.llm import token_store as S
from payloom.llm.common import shared_path


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_give_any_id(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    codes = S.Codes(S.pack(ids))
    assert (codes.all() == ids).all() and len(codes) == n
    for i in range(0, n, max(1, n // 300)):
        assert codes[i] == ids[i]
    with pytest.raises(IndexError):
        codes[n]
    with pytest.raises(ValueError):
        S.Codes(b"nope" + bytes(20))


def test_words_encode_as_the_library_does():
    tokenizer, encoder = Tokenizer.from_file(S.tokenizer_path()), S.WordEncoder(S.tokenizer_path(), cache_words=50)
    rng = random.Random(1)
    texts = [None, "", "don't we'll 'ssh it's!!! A_B-c 12ab3½ ²", "a\x1cb\xa0c\x85d", "İstanbul ΟΔΟΣ 日本 é", "<|endoftext|> x", S.SAFE, " ".join(S.SAFE)]
    texts += ["".join(rng.choice(S.SAFE + "   '''") for _ in range(80)) for _ in range(200)]
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        ids, sizes = encoder.encode(part)
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [S.END_ID] for t in part]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_forgets_rare_words_and_keeps_frequent_ones():
    tokenizer, encoder = Tokenizer.from_file(S.tokenizer_path()), S.WordEncoder(S.tokenizer_path(), cache_words=400)
    rng = random.Random(2)
    for _ in range(30):
        part = ["often, it's " + " ".join("".join(rng.choice("abcdeé") for _ in range(8)) for _ in range(20)) for _ in range(9)] + [None, "日本 often"]
        ids, sizes = encoder.encode(part)
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [S.END_ID] for t in part]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert {"often", ",", "it", "'s"} <= encoder.keys() and len(encoder) <= 400 + 184


def test_memory_of_many_distinct_words():
    """360,000 words, each seen once: what a worker remembers is bounded and small."""
    encoder, name = S.WordEncoder(S.tokenizer_path()), lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:08d}")
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for at in range(0, 360_000, 18_000):
            encoder.encode([" ".join(map(name, range(k, k + 100))) for k in range(at, at + 18_000, 100)])
        assert tracemalloc.get_traced_memory()[0] - before < 90 << 20
    finally:
        tracemalloc.stop()


def test_edges(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    path = shared_path(spark, "t")
    S.write_tokens(edge_docs, path)
    rows = S.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(S.tokenizer_path())
    want = sorted(((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in edge_rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r["doc_id"] for r in rows] == [i for i, _ in want]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == sorted((str(i), ids) for i, ids in want)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    path = shared_path(spark, "t")
    S.write_tokens(no_docs, path)
    assert S.read_tokens(spark, path).count() == 0
