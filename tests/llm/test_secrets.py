import random
import re
import time

from payloom.llm import secrets as S
from payloom.llm.trigrams import trigram_query
from tests.llm.conftest import make_docs


def brute(text):
    out = []
    for k, rule in enumerate(S.RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), k, m.end(), rule.kind))
    return sorted(out)


ROWS = [
    (100, 'API-KEY apikey:"abcdefg" Api_Key = abc token=short secret=token:abcdefgh 🙂 PASSWD:x123456'),
    (101, "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " " + "f" * 23 + "g" + "0" * 24 + "é" + "a1" * 20),
    (102, "ghp_" + "a" * 36 + " xoxb-1234567890 -----BEGIN RSA PRIVATE KEY----- sk_live_" + "Z9" * 8),
    (103, "secret=abcdef " * 600),
    (104, "pasſword=abcdefgh toKen=abcdefgh"),
]


def test_edges_against_brute_force(spark, edge_docs, edge_rows):
    rng = random.Random(3)
    parts = ["password", "=", ":", " ", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "token", "é", "key", "api_", "secret"]
    noise = [(200 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows = edge_rows + ROWS + noise
    got = S.scan_secrets(make_docs(spark, rows)).collect()
    want = sorted(((i, brute(t)) for i, t in rows), key=str)
    assert sorted(((r["row"], [tuple(s) for s in r["found"]]) for r in got), key=str) == want


def test_many_matches_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    text = "é secret=abcdef " * 100
    (row,) = S.scan_secrets(make_docs(spark, [(1, text)])).collect()
    assert [tuple(s) for s in row["found"]] == brute(text)


def test_very_many_matches(spark):
    text = "é secret=abcdef 🙂" * 100_000
    began = time.perf_counter()
    (row,) = S.scan_secrets(make_docs(spark, [(1, text)])).collect()
    assert [tuple(s) for s in row["found"]] == brute(text)
    (row,) = S.redact(make_docs(spark, [(1, text)])).collect()
    assert row["text"] == "é [assign] 🙂" * 100_000
    assert time.perf_counter() - began < 120


def test_large_candidate_sets_are_joined_by_shuffle(spark, edge_docs, monkeypatch):
    key = lambda df: sorted(((r["row"], [tuple(s) for s in r["found"]]) for r in df.collect()), key=str)
    want = key(S.scan_secrets(edge_docs))
    monkeypatch.setattr(S, "BROADCAST_CANDIDATES", 0)
    assert key(S.scan_secrets(edge_docs)) == want


def test_overlapping_spans_are_one_mark(spark):
    rows = [(1, "é token=" + "0" * 30 + " x"), (2, "é" * 5 + "AKIA" + "A" * 16), (3, "0" * 24)]
    got = {r["doc_id"]: r["text"] for r in S.redact(make_docs(spark, rows)).collect()}
    assert got == {1: "é [assign] x", 2: "é" * 5 + "[access]", 3: "[hex]"}


def test_redaction(spark, edge_docs, no_docs):
    kept = S.redact(edge_docs)
    assert kept.columns == edge_docs.columns and kept.schema == edge_docs.schema
    row = kept.where("doc_id = 9").first()
    assert row["text"] == "config [assign]\" and [access] then [hex] end" and row["n_chars"] == len(row["text"])
    before = {(r["doc_id"], r["text"]) for r in edge_docs.collect() if r["doc_id"] not in (9, 15, 16)}
    assert {(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] not in (9, 15, 16)} == before
    assert S.redact(no_docs).count() == 0 and S.scan_secrets(no_docs).count() == 0


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{24,}") == []
    assert trigram_query("abc|xyz") == [[frozenset({"abc"}), frozenset({"xyz"})]]
    assert trigram_query("abcd?e") == [[frozenset({"abc", "bcd", "cde"}), frozenset({"abc", "bce"})]]
    assert trigram_query("(ab)+c") == [] and trigram_query("[Aa]bc.*def") == [[frozenset({"abc"})], [frozenset({"def"})]]


def test_plan_has_no_python(spark, edge_docs):
    plan = S.scan_secrets(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
