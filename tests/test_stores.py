import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from payloom.operators import corpora as C
from payloom.operators import grams as G
from payloom.operators import statistics as S
from payloom.operators.stores import LARGE, SMALL, BloomStore, ExactStore, bloom_entries
from payloom.streaming import counts as stream

SIZE = {"k": 4, "m_of": {2: 1009, 3: 5003}}


def payloads(spark, seed, n=60):
    rng = random.Random(seed)
    rows = [(i, bytes(rng.choice(b"abcd\x00\xff") for _ in range(rng.randint(0, 30)))) for i in range(n)] + [(1000, None), (1001, b"")]
    return spark.createDataFrame(rows, "id int, payload binary"), [p for _, p in rows if p]


def expected(data, n):
    return Counter(p[i : i + n] for p in data for i in range(len(p) - n + 1))


def table(counts):
    return {(r["n"], bytes(r["g"])): r["cnt"] for r in counts.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 9, 20])
def test_counts_against_plain_ones(spark, n, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 50)
    df, data = payloads(spark, n)
    want = {(n, g): c for g, c in expected(data, n).items()}
    assert table(G.gram_counts(df, n)) == want
    assert table(G.explode_grams(df, n).groupBy("n", "g").agg(F.count("*").alias("cnt"))) == want


def test_compat_drops_short_payloads(spark):
    df, data = payloads(spark, 3)
    long = [p for p in data if len(p) >= 9]
    want = {(n, g): c for n in (2, 10) for g, c in expected(long, n).items()}
    got = {k: v for k, v in table(G.gram_counts(df, 2, 10, compat=True)).items() if k[0] in (2, 10)}
    assert got == want
    assert table(G.explode_grams(df, 2, 10, compat=True).where("n IN (2, 10)").groupBy("n", "g").agg(F.count("*").alias("cnt"))) == want


@pytest.mark.parametrize("n", [24, 25, 40])
def test_long_grams_by_runs(spark, n, monkeypatch):
    """Counts are exact over chunks, tasks and blocks of keys, with copies, overlaps and payloads of one byte value."""
    rng = random.Random(n)
    line = bytes(rng.randrange(256) for _ in range(60))
    data = [b"a" * 200, b"ab" * 60, b"", line[:n], line[: n - 1], line, line, b"x" + line + b"y" + line[10:], *(bytes(rng.choice(b"ab") for _ in range(rng.randrange(90))) for _ in range(60))]
    df = spark.createDataFrame([(bytearray(p),) for p in data] + [(None,)], "payload binary").repartition(4)
    want = {(n, g): c for g, c in expected(data, n).items()}
    assert table(G.gram_counts(df, n)) == want
    monkeypatch.setattr(G, "CHUNK", 50)
    runs = [t for block in G._blocks(iter([pa.record_batch([pa.array(data, pa.binary())], ["payload"])]), 0) for t in G._runs(*block, n).to_pylist()]
    runs = pa.RecordBatch.from_pylist(sorted(runs, key=lambda r: r["key"]), pa.schema([("key", pa.int64()), ("body", pa.binary()), ("cnt", pa.int64())]))
    parts = [b for b in G._count_runs((runs.slice(i, 3) for i in range(0, len(runs), 3)), n)]
    assert len(parts) > 3 and Counter({(n, r["g"]): r["cnt"] for b in parts for r in b.to_pylist()}) == want
    monkeypatch.setattr(G, "_mixed", lambda parts: parts[0] % np.uint64(3))  # many different grams of one hash
    block, weight = np.frombuffer(b"abcabd" * 30 + line, np.uint8), np.full(240, 2)
    grams, counts = G._count(block, 240 - np.arange(240), n, weight)
    assert {bytes(g): c for g, c in zip(grams, counts.tolist(), strict=True)} == {g: 2 * c for g, c in expected([block.tobytes()], n).items()}


def test_long_grams_are_shuffled_compressed(monkeypatch):
    """Runs filled the disk with 4 bytes a gram; a task's packs have all of them in fewer, and come back by ranges of keys."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiouthns") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    data = [" ".join(rng.choice(words) for _ in range(250)).encode() for _ in range(300)] * 2
    runs = [G._runs(*block, 40) for block in G._blocks(iter([pa.record_batch([pa.array(data, pa.binary())], ["payload"])]), 0)]
    monkeypatch.setattr(G, "UNIT", 400_000)
    packs = list(G._packs(iter(runs + runs[:1])))
    assert sum(b.nbytes for b in packs) < 2.6 * sum(len(p) - 39 for p in data)
    rows = sorted((r for b in packs for r in b.to_pylist()), key=lambda r: r["bucket"])
    monkeypatch.setattr(G, "UNIT", 500)
    back = pa.Table.from_batches(G._unpacks(iter([pa.RecordBatch.from_pylist(rows, packs[0].schema)])))
    assert back["key"].to_pylist() == sorted(back["key"].to_pylist())
    back = G._distinct(back)
    want = G._distinct(pa.concat_tables(runs + runs[:1])).sort_by([("key", "ascending"), ("body", "ascending")])
    assert back.sort_by([("key", "ascending"), ("body", "ascending")]).to_pylist() == want.to_pylist()


def test_only_the_sizes_asked_are_counted(spark):
    """Counting grams that a filter would drop took longer than the limit at 0.1 GB."""
    data = [bytes(range(k)) for k in (0, 2, 38, 39, 40, 60)]
    df = spark.createDataFrame([(bytearray(p),) for p in data], "payload binary")
    assert table(G.gram_counts(df, 2, 40, compat=True, only=(2, 40))) == {(n, g): c for n in (2, 40) for g, c in expected(data[3:], n).items()}


@pytest.mark.parametrize("kind", [ExactStore, BloomStore])
def test_merge_delete_save_load(spark, tmp_path, kind):
    size = SIZE if kind is BloomStore else {}
    (a, _), (b, _) = payloads(spark, 1), payloads(spark, 2)
    one, two = kind.build(a, 2, 3, **size), kind.build(b, 2, 3, **size)
    key = lambda s: sorted((r["n"], bytes(r["g"]) if "g" in r else r["spot"], r["cnt"]) for r in s.table.collect())
    both = kind.build(a.unionByName(b), 2, 3, **size)
    assert key(one.merge(two)) == key(both) == key(one.add(b))
    assert key(both.delete(b)) == key(one) and one.delete(a).table.count() == 0
    both.save(str(tmp_path / "s"))
    loaded = kind.load(spark, str(tmp_path / "s"), 2, 3, **size)
    assert key(loaded) == key(both)
    two.save(str(tmp_path / "t"))
    one.save(str(tmp_path / "t"), mode="append")
    assert key(kind.load(spark, str(tmp_path / "t"), 2, 3, **size)) == key(both)
    assert {r["n"]: r["total"] for r in spark.read.parquet(str(tmp_path / "s/label")).collect()} == {r["n"]: r["total"] for r in both.label().collect()}


def test_bloom_never_undercounts(spark):
    df, data = payloads(spark, 5)
    store = BloomStore.build(df, 2, 3, **SIZE)
    exact = G.gram_counts(df, 2, 3)
    rows = exact.join(store.find(exact.select("n", "g")), ["n", "g"]).collect()
    assert rows and all(r["found"] >= r["cnt"] for r in rows)
    assert store.table.agg(F.sum("cnt")).first()[0] == SIZE["k"] * sum(sum(expected(data, n).values()) for n in (2, 3))
    absent = spark.createDataFrame([(2, b"zz")], "n int, g binary")
    assert store.find(absent).first()["found"] <= 2


def test_saturation(spark):
    df = spark.createDataFrame([(b"a" * 70_000,)], "payload binary")
    row = ExactStore.build(df, 1).counters().first()
    assert (row["counter"], row["overflow"]) == (65520, 70_000 - 65520)
    kept = ExactStore.build(df, 1).delete(spark.createDataFrame([(b"aaa",)], "payload binary"))
    assert kept.table.first()["cnt"] == 65520


def test_sizes():
    assert [bloom_entries(n) for n in (1, 2, 3, 4, 20)] == [600, 100_000, 20_000_000, 16_777_216, 268_435_456]
    assert (LARGE.m(4), LARGE.k, SMALL.m(1), SMALL.k) == (16_777_216 * 32, 23, 12_000, 14)


def test_comparison(spark):
    a, _ = payloads(spark, 1)
    b, _ = payloads(spark, 9)
    store = ExactStore.build(a, 3)
    assert C.compare(a, store).first()["fraction"] == 1
    row = C.compare(b, store).first()
    assert row["found"] + row["not_found"] == row["total"] == C.compare_histogram(b, store).agg(F.sum("weight")).first()[0]


def test_walk_uses_known_grams(spark):
    df, _ = payloads(spark, 4)
    counts = G.gram_counts(df, 3)
    known = {bytes(r["g"]) for r in counts.collect()}
    rows = C.walk(counts, 3, 50, walks=5, seed=3).collect()
    again = C.walk(counts, 3, 50, walks=5, seed=3).collect()
    assert [bytes(r["text"]) for r in rows] == [bytes(r["text"]) for r in again]
    for r in rows:
        t = bytes(r["text"])
        assert len(t) == 50 and sum(t[i : i + 3] in known for i in range(48)) > 30


def test_sequence_over_blocks_equals_one_window(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(i * 3, "k", rng.random()) for i in range(500)], "pos long, key string, x double")
    want = S.sequence_stats(df, "x", "pos", "key").first()
    monkeypatch.setattr(S, "BLOCK", 64)
    got = S.sequence_stats(df, "x", "pos").first()
    assert all(got[c] == pytest.approx(want[c]) for c in ("n", "mu", "sigma", "rho", "min", "max"))


def test_constant_sequence_has_no_correlation(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "pos long, x double")
    assert S.sequence_stats(df, "x", "pos").first()["rho"] is None


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(b"abcabc",), (b"abx",)], "payload binary")
    rows.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("payload binary").parquet(str(tmp_path / "in"))
    q = stream.stream_to_store(source(), str(tmp_path / "store"), str(tmp_path / "c"), 2)
    q.awaitTermination(60)
    store = stream.load_stream_store(spark, str(tmp_path / "store"), 2)
    assert table(store.table) == {(2, b"ab"): 3, (2, b"bc"): 2, (2, b"ca"): 1, (2, b"bx"): 1}
    q = stream.running_counts(source(), 2).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert table(spark.table("running")) == table(store.table)


def test_label_of_appended_store(spark, tmp_path):
    a, b = (spark.createDataFrame([(bytearray(t),)], "payload binary") for t in (b"abcabcabc" * 30, b"xyz"))
    for kind, size in ((ExactStore, {}), (BloomStore, {"k": 23, "m_of": {3: 9973}})):
        path = str(tmp_path / kind.__name__)
        kind.build(a, 3, **size).save(path)
        kind.build(b, 3, **size).save(path, mode="append")
        assert spark.read.parquet(f"{path}/label").first()["total"] == 268 + 1
        assert kind.load(spark, path, 3, 3, **size).label().first()["total"] == 268 + 1


def test_filter_keeps_what_was_not_added(spark):
    a, b = (spark.createDataFrame([(bytearray(t),)], "payload binary") for t in (b"aaa" + b"bbb", b"qrstuvwxyz" * 3))
    store = BloomStore.build(a, 3, k=5, m_of={3: 9973})
    assert sorted(store.delete(b).table.collect()) == sorted(store.table.collect())
    assert store.delete(a).table.count() == 0
