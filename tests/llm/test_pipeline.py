from pyspark.sql import functions as F

import corpus_pipeline as C
from payloom.llm.toxicity import THRESHOLD, score, train


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given, counts = docs, {}
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, given, sf).cache()
        assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
        counts[name] = (given.count(), kept.count())
        if name == "toxicity":
            model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            bad = {r["row"] for r in score(docs, model).where(f"score >= {THRESHOLD}").collect()}
            assert {r["doc_id"] for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()} == bad
        if name == "secrets":
            assert kept.select("doc_id").subtract(given.select("doc_id")).count() == 0 and counts[name][0] == counts[name][1]
        given = kept
    assert counts["near_dedup"][1] < counts["near_dedup"][0]
    last = C.STAGES[-1][1](spark, given, sf)
    assert last.where("decoded").count() == given.count()
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "pieces"]


def test_run_gives_the_last_stage(spark, sf):
    got = C.run(spark, sf)
    assert got.columns == ["doc_id", "n_pieces", "ids_crc32", "n_best", "scores", "decoded"] and got.count() > 0


def edge_rows(spark, sf):
    """Nulls, no words, whitespace, repeated rows, ties, a very long text with a near copy, and columns that clash with inner names."""
    long = " ".join(f"w{i} q{i % 7}" for i in range(4000))
    plain = "a few plain words that are fine here today"
    rows = [(1, None), (2, ""), (3, plain), (3, plain), (4, plain), (5, None), (None, "text without an id that has some words"), (6, long), (7, long + " end"), (8, "password = hunter2hunter2 and more"), (9, "   \n\t "), (None, None)]
    kinds = dict(spark.read.parquet(f"{sf}/documents.parquet").dtypes)
    more = [F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in ("doc_id", "text")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *more, *[F.lit("x").alias(c) for c in ("body", "row", "score", "component_id", "kind")])


def test_stages_on_edge_rows(spark, sf):
    docs = edge_rows(spark, sf)
    want = {
        "toxicity": [None, None, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9],
        "near_dedup": [None, 1, 3, 6, 8],  # texts without words are copies of each other; of repeated rows one stays
        "decontamination": [None, 1, 3, 6, 8],
        "secrets": [None, 1, 3, 6, 8],
        "pieces": [None, 1, 3, 6, 8],
    }
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert sorted((r["doc_id"] for r in rows), key=lambda i: -1 if i is None else i) == want[name]
        if name != "pieces":
            assert out.columns == docs.columns and all(r["body"] == r["row"] == r["kind"] == "x" for r in rows)
            docs = spark.createDataFrame(rows, out.schema)
        if name == "secrets":
            assert {r["text"] for r in rows if r["doc_id"] == 8} == {"[assign] and more"}
    assert {r["doc_id"]: r["n_pieces"] for r in rows}[1] == 0 and all(r["decoded"] for r in rows)


def test_stages_on_an_empty_table(spark, sf):
    docs = edge_rows(spark, sf).limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, sf).count() == 0
