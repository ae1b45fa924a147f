import zlib

import numpy as np
import pytest
import zstandard

from payloom.llm import quality as Q
from payloom.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def held(ids, modulus, at):
    return np.array([zlib.crc32(str(i).encode()) % modulus == at for i in ids])


def joined(spark, query, label):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = query(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == docs.count()
    return got.merge(labels, on="doc_id"), label


@pytest.mark.parametrize(("query", "label", "modulus", "at", "least"), [(Q.op6_quality, "quality", 5, 0, 0.96), (X.op9_toxicity, "toxic", 4, 2, 0.95)])
def test_held_out_accuracy(spark, query, label, modulus, at, least):
    rows, _ = joined(spark, query, label)
    assert (rows["held_out"] == held(rows["doc_id"], modulus, at)).all()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()
    out = rows[rows["held_out"]]
    assert (out["predicted"] == out[label]).mean() >= least
    low, high = out[out[label] == 0]["score"].mean(), out[out[label] == 1]["score"].mean()
    assert high > low + 0.3


def test_pairs_are_learnt():
    """Two words that say nothing alone: toxic if just one of them is there, which no sum of weights can tell."""
    rng, rows, labels = np.random.default_rng(0), [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        words = {1: a, 2: b}
        rows.append(np.array(sorted([k for k, v in words.items() if v] + rng.choice(np.arange(10, 60), 5, replace=False).tolist()), np.int32))
        labels.append(int(a ^ b))
    model = X.fit(rows, np.array(labels))
    assert np.mean([(model.score(r) >= 0.3) == y for r, y in zip(rows, labels, strict=True)]) > 0.99
    v = {int(c): model.factors[i] for i, c in enumerate(model.columns)}
    assert v[1] @ v[2] < 0


def test_toxicity_scores_by_a_plain_double_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 4000")
    model = X.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    model.factors = np.random.default_rng(1).normal(0, 0.2, model.factors.shape)  # the test tables teach few pairs
    place = {int(c): i for i, c in enumerate(model.columns)}
    bodies = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 60").collect()}
    got = {r["row"]: r["score"] for r in X.score(docs, model).where("row < 60").collect()}
    for i, text in bodies.items():
        words = set((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))).split())
        at = [place[c] for c in {zlib.crc32(w) & (1 << 26) - 1 for w in words} if c in place]
        raw = model.bias + sum(model.linear[k] for k in at)
        for x in range(len(at)):
            for y in range(x):
                raw += sum(float(p) * float(q) for p, q in zip(model.factors[at[x]], model.factors[at[y]], strict=True))
        assert abs(got[i] - 1 / (1 + np.exp(-(model.slope * raw + model.offset)))) < 1e-9


def test_quality_sizes_by_direct_calls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = Q.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.compressors.good.trained and model.compressors.bad.trained
    options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}

    def size(part, data):
        given = {"dict_data": zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT)} if data else {}
        return len(zstandard.ZstdCompressor(level=Q.LEVEL, **given, **options).compress(part))

    got = {r["doc_id"]: r["score"] for r in Q.score(docs, model).where("doc_id < 40").collect()}
    for r in docs.where("doc_id < 40").collect():
        text = (r["text"] or "").encode()
        good, bad, plain = (sum(size(text[a : a + Q.WINDOW], d) for a in range(0, max(1, len(text)), Q.WINDOW)) for d in (model.compressors.good.data, model.compressors.bad.data, None))
        n = max(1, len(text))
        raw = sum(w * x for w, x in zip(model.weights.tolist(), ((bad - good) / plain, good / n, bad / n, 1.0), strict=True))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-raw))) < 1e-9


def test_clashing_columns_and_repeated_rows_of_labels(spark, edge_docs):
    rows = [(i, i % 2, i % 2, "x", 0.5, 7) for i in range(1, 17) for _ in range(2)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, body string, label double, id int")
    for part in (Q, X):
        assert part.score(edge_docs, part.train(edge_docs, labels)).count() == edge_docs.count()


@pytest.mark.parametrize("part", [Q, X])
def test_edges(spark, edge_docs, edge_rows, no_docs, part):
    label = "quality" if part is Q else "toxic"
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(3, 1), (None, 1), (4, None)], f"doc_id bigint, {label} int")
    for given in (labels, labels.limit(0), labels.where(f"{label} = 1")):
        model = part.train(edge_docs, given)
        rows = part.score(edge_docs, model).collect()
        assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
        same = {r["score"] for r in rows if r[0] == 12}
        assert len(same) == 1
    model = part.train(no_docs, labels)
    assert part.score(no_docs, model).count() == 0
    assert part.score(edge_docs, model).count() == len(edge_rows)


def test_dropping(spark, edge_docs):
    model = X.Machine(-5.0, np.array([zlib.crc32(b"words") & (1 << X.BITS) - 1], np.int32), np.array([10.0]), np.zeros((1, X.FACTORS)))
    kept = X.drop_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in edge_docs.subtract(kept).collect()} == {5}
