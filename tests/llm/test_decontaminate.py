import random
import re

from payloom.llm.decontaminate import drop_contaminated, find_leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs, items, window):
    wins = []
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        k = min(window, len(w))
        wins += [(i, tuple(w[a : a + k])) for a in range(len(w) - k + 1)] if w else []
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t or ""))
        hit, ids = set(), set()
        for i, win in wins:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    if i is not None:
                        ids.add(str(i))
        out.append((d, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = find_leaks(docs, bench, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["hit_words"]), tuple(r["item_ids"])) for r in rows), key=str), rows


def test_edges_against_brute_force(spark, edge_docs, edge_rows):
    big = next(t for i, t in edge_rows if i == 7)
    items = [(1, None), (2, "!!"), (3, "Two, WORDS"), (4, " ".join(big.split()[20:35])), (4, " ".join(big.split()[20:35])), (None, "one"), (10, "password = hunter2hunter2"), (11, "ÉTA")]
    short = [(i, t) for i, t in edge_rows if not t or len(t) < 10_000]
    for options in ({"window": 5}, {"window": 10}, {"window": 5, "block_bytes": 40}):
        got, _ = run(spark, edge_docs, items, **options)
        want = brute(short, items, options["window"])
        assert [g for g in got if g[0] not in (8,)] == [w for w in want if w[0] != 8]


def test_spans_are_in_the_original(spark):
    docs = spark.createDataFrame([(1, "Zé — The QUICK, brown\tfox!  end")], "doc_id bigint, text string")
    _, rows = run(spark, docs, [(1, "the quick brown")], window=3)
    (span,) = rows[0]["hit_spans"]
    assert "Zé — The QUICK, brown\tfox!  end"[span["start"] : span["end"]] == "The QUICK, brown"


def test_empty_tables_and_dropping(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "two words")], "item_id bigint, text string")
    none = items.limit(0)
    assert find_leaks(no_docs, items).count() == 0
    assert all(not r["hit_words"] for r in find_leaks(edge_docs, none).collect())
    kept = drop_contaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 1


def test_many_places_against_brute_force(spark):
    """Few words, so that each pattern stands at many places of many items."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, say(rng.randint(1, 14))) for i in range(60)] + [(90, None), (91, " "), (None, say(9))]
    docs = [(i, say(rng.randint(0, 40))) for i in range(80)] + [(81, "a " * 50)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for window in (1, 2, 5, 8, 10):
        assert run(spark, frame, items, window=window)[0] == brute(docs, items, window)


def test_clashing_columns_of_items(spark, edge_docs):
    items = spark.createDataFrame([(1, "two words", "x", "y", 3, None)], "item_id bigint, text string, item string, body string, leaks int, doc_id string")
    rows = {r["doc_id"]: r["item_ids"] for r in find_leaks(edge_docs, items).collect()}
    assert rows[5] == ["1"] and rows[6] == []
