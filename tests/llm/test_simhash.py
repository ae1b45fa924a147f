import random
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from payloom.llm import common as C
from payloom.llm import components as K
from payloom.llm import simhash as S
from payloom.llm.components import connected, forest, split_join
from tests.llm.conftest import make_docs


def fingerprint(text, k=3):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def components(prints, ids, radius):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, i in zip(group, ids, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in group]


def test_edges_against_brute_force(spark, edge_docs, edge_rows):
    got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in S.near_duplicates(edge_docs).collect()), key=str)
    prints = [fingerprint(t) for _, t in edge_rows]
    assert got == sorted(zip([i for i, _ in edge_rows], prints, components(prints, [i for i, _ in edge_rows], 2), strict=True), key=str)


def test_links_of_planted_prints(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 16)
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for base in prints[:30]:
        for _ in range(rng.randint(1, 6)):
            prints.append(prints[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if rng.random() < 0.5 else base ^ (1 << rng.randrange(64)))
    prints = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = {r["node"] & (1 << 64) - 1: r["root"] for r in connected(S.links(df, 2)).collect()}
    want = components(prints, prints, 2)
    root = {p: found.get(p, int(np.uint64(p).view(np.int64))) for p in prints}
    pairs = lambda m: {(a, b) for a in prints for b in prints if m[a] == m[b]}
    assert pairs(root) == pairs(dict(zip(prints, want, strict=True)))


def test_connected(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 1), (5, 5), (3, 2), (None, 4)] + [(1000, i) for i in range(1001, 1100)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {2: 1, 3: 1} | {i: 1000 for i in range(1001, 1100)}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_few_edges_are_connected_by_one_task(spark, monkeypatch):
    """Components of a bounded number of edges take three tables, however long their paths; a round of stars takes four."""
    rng = random.Random(7)
    name = rng.sample(range(-5000, 5000), 700)
    edges = [(name[i], name[i + 1]) for i in range(400)] + [(name[rng.randrange(420, 560)], name[rng.randrange(420, 560)]) for _ in range(120)] + [(name[600], name[i]) for i in range(601, 700)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    binary = df.select(*[F.unhex(F.lpad(F.hex(F.col(c) + 5000), 16, "0")).alias(c) for c in "uv"])
    written = []
    monkeypatch.setattr(K, "stored", lambda df, name: written.append(name) or C.stored(df, name))
    got = {r["node"]: r["root"] for r in connected(df).collect()}
    assert len(written) <= 3
    bytewise = {int(r["node"].hex(), 16) - 5000: int(r["root"].hex(), 16) - 5000 for r in connected(binary).collect()}
    monkeypatch.setattr(K, "FEW", 0)
    stars = {r["node"]: r["root"] for r in connected(df).collect()}
    assert got == stars == bytewise and len(written) > 12
    nodes = sorted(name)
    at = {x: i for i, x in enumerate(nodes)}
    root = forest(len(nodes), *(np.array([at[e[k]] for e in edges]) for k in (0, 1)))
    assert {x: nodes[r] for x, r in zip(nodes, root.tolist(), strict=True) if nodes[r] != x} == got


def test_long_paths_take_few_steps():
    n = 200_000
    path = np.random.default_rng(1).permutation(n)
    began = time.process_time()
    assert not forest(n, path[:-1], path[1:]).any()
    assert time.process_time() - began < 20


def test_one_of_each_group_stays(spark, edge_docs, no_docs):
    rng = random.Random(4)
    text = [f"w{rng.randrange(500)}" for _ in range(300)]
    near = text[:]
    near[150] = "changed"
    far = [w if rng.random() > 0.2 else "z" for w in text]
    rows = [(5, " ".join(text)), (3, " ".join(text)), (4, " ".join(near)), (9, " ".join(far)), (10, "short text"), (10, "short text"), (None, "short text"), (None, None), (2, None)]
    kept = S.keep_one(make_docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 9, 10]
    assert kept.columns == edge_docs.columns
    assert S.keep_one(no_docs).count() == 0 and S.near_duplicates(no_docs).count() == 0
    assert S.keep_one(edge_docs).count() == 14


def test_similarity_against_brute_force(spark):
    rng = random.Random(11)
    sets, rows = [], []

    def add(words):
        shingles = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        sets.append(shingles)
        rows.append((len(rows), " ".join(words)))

    fresh = iter(range(10**6)).__next__
    for size in (4, 5, 8, 9, 12, 20, 40, 100, 300):
        for _ in range(14):
            base = [f"w{fresh()}" for _ in range(size + 4)]
            add(base)
            if size < 40:
                add(base + [f"w{fresh()}" for _ in range(rng.randint(1, 1 + size // 4))])
            else:
                cut = rng.uniform(0.10, 0.15)  # of the shingles on either side: Jaccard 0.74 to 0.82
                add(base[: -round(size * cut)] + [f"w{fresh()}" for _ in range(round(size * cut))])
                add(base + [f"w{fresh()}" for _ in range(round(size * rng.uniform(0.15, 0.3)))])
    kept = {r["doc_id"] for r in S.keep_one(make_docs(spark, rows)).collect()}
    assert kept == smallest_of_groups(sets)


def smallest_of_groups(sets):
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return {i for i, g in enumerate(group) if i == g}


def test_large_blocks_against_brute_force(spark, monkeypatch):
    """Many texts around few originals, and a passage that all texts share: blocks of many tiles."""
    monkeypatch.setattr(S, "TILE", 8)
    monkeypatch.setattr(S, "CELL", 16)
    monkeypatch.setattr(S, "COLUMNS", 64)
    monkeypatch.setattr(S, "LEAST_COMMON", 10_000)
    rng = random.Random(3)
    fresh = iter(range(10**6)).__next__
    passage = [f"p{i}" for i in range(30)]
    bases = [[f"w{fresh()}" for _ in range(n)] for n in (40, 90, 120)]
    texts = []
    for k in range(120):
        words = bases[k % 3][:]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"w{fresh()}"
        texts.append(passage + words[: len(words) - rng.randint(0, 12)])
    texts += [passage + [f"w{fresh()}" for _ in range(rng.randint(20, 80))] for _ in range(60)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    docs = make_docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    want = smallest_of_groups(sets)
    assert {r["doc_id"] for r in S.keep_one(docs).collect()} == want and 63 < len(want) < 150
    monkeypatch.setattr(S, "LEAST_COMMON", 16)  # the passage's shingles come last in the order: the same groups
    assert {r["doc_id"] for r in S.keep_one(docs).collect()} == want


def test_no_task_gathers_a_star(spark):
    """Edges of a node with a third of all edges stay where they are: only the other nodes are dealt out."""
    edges = spark.range(60_000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(1_000_000 + F.col("id"))).alias("u"), (F.col("id") + 100).alias("v"))
    got = connected(edges)
    assert got.where("root = 7").count() == 20_000 and got.count() == 60_000
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("cnt"))
    rest = edges.join(least.where("cnt * 512 <= 60000"), "u")
    assert rest.groupBy("u").count().agg(F.max("count")).first()[0] == 1
    assert split_join(edges, least, "u", 60_000).count() == 60_000


def test_near_dedup_leaves_little_behind(spark, edge_docs):
    """Prefixes, tiles and rounds go once they are used, and whole rows are shuffled once; else all add up on disk."""
    C.clean(spark)
    kept = S.keep_one(edge_docs)
    left = [path.rsplit("/", 1)[1].split("-")[0] for path in C._MADE[spark.sparkContext.applicationId]]
    assert not {"prefixes", "grouped", "tiles", "keys"} & set(left) and left.count("edges") <= 3
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert len(ids) == len(set(ids)) and kept.columns == edge_docs.columns


def test_near_dedup_starts_no_processes_for_files(spark, edge_docs, tmp_path):
    """A child process that a JVM starts shares its memory until it runs, so each counts an executor's memory twice."""
    jvm = spark._jvm
    watch = jvm.jdk.jfr.Recording()
    watch.enable("jdk.ProcessStart")
    watch.start()
    assert S.keep_one(edge_docs).count() > 5
    watch.stop()
    path = jvm.java.nio.file.Path.of(str(tmp_path / "started.jfr"), spark.sparkContext._gateway.new_array(jvm.String, 0))
    watch.dump(path)
    watch.close()
    started = [e.getString("command") for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(path)]
    assert not [c for c in started if "chmod" in c]


def test_candidates_are_few_and_in_parts(spark, monkeypatch):
    """Unlike texts of one block chained into components of candidates, all pairs of which were shuffled and verified."""
    rng = random.Random(6)
    texts = [" ".join(["one", "passage", "for", "every", "text", *(f"w{rng.randrange(10**6)}" for _ in range(60))]) for _ in range(600)]
    near = [t.rsplit(" ", 2)[0] + " other end" for t in texts[:20]]
    rows = S.utf8(F.col("text")).alias("body")
    docs = make_docs(spark, list(enumerate(texts + near)))
    found = S.prefixes(docs.select(F.col("doc_id").alias("content"), rows), S.Bits(np.full(C.FILTER_BITS // 8, 255, np.uint8)), np.empty(0, np.uint64), 0.8, 5)
    blocks = found.drop("keys").select(F.lit(1).alias("key"), F.lit(620).alias("n_key"), "*")
    assert connected(S.candidates(S.tile_pairs(S.tiled(blocks, 0.8)))).count() == 20
    want = set(range(600))
    assert {r["doc_id"] for r in S.keep_one(docs).collect()} == want
    monkeypatch.setattr(S, "PART_ROWS", 50)
    monkeypatch.setattr(S, "PART_SETS", 16)
    monkeypatch.setattr(S, "CELL", 8)
    assert {r["doc_id"] for r in S.keep_one(docs).collect()} == want
