"""Quality scores by compression against two dictionaries.

Labelled rows outside the held-out part give two zstandard dictionaries, one of good texts and one of bad texts. A text
is compressed with each; (size with bad - size with good) / (size without dictionary) is its normalised difference, and
a logistic fit on labelled rows that made no dictionary turns that and its sign-free companions into a score between 0
and 1. Texts longer than `WINDOW` bytes are compressed window by window and their sizes added, so that a dictionary
keeps its weight however long a text is.

Training takes at most `SAMPLE` labelled rows (the documented bound; those with the smallest hash of the id), and their whole
texts stay on the executors. Texts of the first part are cut into pieces of `PIECE` bytes, of which each class's `PIECES`
with the smallest hash, from wherever in the texts, train its dictionary; of the second part three sizes a row reach the
driver. Scoring reads whole texts in one pass, without shuffle; two dictionaries of `DICTIONARY` bytes are broadcast.

Defined results: null and empty texts are compressed as empty and score what the fit says of that; rows without label train
nothing; repeated documents each get their row; of rows that repeat an id the text with the smallest hash counts; with no labelled rows, or of
one class only in either part, every score is the share of good labels (0.5 with none). Where texts are too few for zstandard's trainer
to make a dictionary of them, their pieces themselves are the dictionary. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom.llm.common import remainder, slices, stored, table, utf8

SAMPLE = 12_000
PIECE, PIECES = 1024, 8192
WINDOW = 4096
DICTIONARY = 64 << 10
LEVEL = 3
HOLD = 40
THRESHOLD = 0.3
MODULUS, HELD = 5, 0


@dataclass
class Dictionary:
    """trained: made by zstandard's trainer, with its entropy tables; else plain content."""

    data: bytes
    trained: bool


@dataclass
class Compressors:
    """Sizes under the two dictionaries and under none."""

    good: Dictionary
    bad: Dictionary
    made: list = field(default_factory=list)

    def __getstate__(self) -> dict:
        return {"good": self.good, "bad": self.bad, "made": []}

    def sizes(self, text: bytes | None) -> tuple[int, int, int]:
        import zstandard

        if not self.made:
            options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            for d in (self.good, self.bad):
                loaded = zstandard.ZstdCompressionDict(d.data, dict_type=zstandard.DICT_TYPE_FULLDICT if d.trained else zstandard.DICT_TYPE_RAWCONTENT)
                loaded.precompute_compress(level=LEVEL)
                self.made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded, **options).compress)
            self.made.append(zstandard.ZstdCompressor(level=LEVEL, **options).compress)
        text = text or b""
        good = bad = plain = 0
        for at in range(0, max(1, len(text)), WINDOW):
            part = text[at : at + WINDOW]
            good += len(self.made[0](part))
            bad += len(self.made[1](part))
            plain += len(self.made[2](part))
        return good, bad, plain

    def features(self, text: bytes | None) -> np.ndarray:
        good, bad, plain = self.sizes(text)
        n = max(1, len(text or b""))
        return np.array([(bad - good) / plain, good / n, bad / n, 1.0])


@dataclass
class Model:
    compressors: Compressors
    weights: np.ndarray | None
    constant: float = 0.5

    def score(self, text: bytes | None) -> float:
        if self.weights is None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.compressors.features(text) @ self.weights, -40, 40))))


def dictionary(pieces: list[bytes], size: int = DICTIONARY) -> Dictionary:
    """A dictionary of the given size, or an eighth of the pieces where those are few, by zstandard's trainer."""
    import zstandard

    size = min(size, max(256, sum(map(len, pieces)) // 8))
    try:
        return Dictionary(zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes(), True)
    except zstandard.ZstdError:  # too few or too short
        return Dictionary(b"".join(pieces)[-DICTIONARY:] or b"\n" * 8, False)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic fit by damped Newton steps on standardised columns; the last column is the constant."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[-1], spread[-1] = 0.0, 1.0
    spread[spread == 0] = 1.0
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    out = w / spread
    out[-1] = w[-1] - (out[:-1] * mean[:-1]).sum()
    return out


def _pieces(rows: DataFrame, label: int) -> list[bytes]:
    """Of the pieces of the class's texts those with the smallest hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [t[i : i + PIECE] for t in batch.column(0).to_pylist() for i in range(0, len(t), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["piece"])

    cut_up = rows.where((F.col("label") == label) & ~F.col("hold")).select("body").mapInArrow(cut, "piece binary")
    return [bytes(r["piece"]) for r in cut_up.orderBy(F.xxhash64("piece"), "piece").limit(PIECES).collect()]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", modulus: int = MODULUS, held: int = HELD, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows outside the held-out part, `sample` at most: dictionaries on some, calibration on the others."""
    named = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).where(remainder(F.col(label_id_col), modulus) != held)
    named = named.groupBy(F.col(label_id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(sample)
    body = F.coalesce(utf8(F.col(text_col)), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("body").alias("h"), F.col("body"))).alias("one"))
    hold = F.pmod(F.xxhash64(F.lit("hold"), F.col("id")), F.lit(100)) < HOLD
    rows = stored(rows.select("label", hold.alias("hold"), F.col("one.body").alias("body")), "labelled")
    counts = {(r["label"], r["hold"]): r["n"] for r in rows.groupBy("label", "hold").agg(F.count("*").alias("n")).collect()}
    if any(not counts.get((label, part)) for label in (0, 1) for part in (False, True)):
        total = sum(counts.values())
        return Model(Compressors(Dictionary(b"", False), Dictionary(b"", False)), None, sum(n * label for (label, _), n in counts.items()) / total if total else 0.5)
    compressors = Compressors(dictionary(_pieces(rows, 1)), dictionary(_pieces(rows, 0)))
    shared = docs.sparkSession.sparkContext.broadcast(compressors)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["label", "features"])

    got = rows.where("hold").select("label", "body").mapInArrow(measure, "label int, features array<double>").toPandas()
    got = got.assign(key=got["features"].map(tuple)).sort_values(["key", "label"])  # one order at every number of tasks
    return Model(compressors, logistic(np.stack(got["features"].tolist()), got["label"].to_numpy(np.float64)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), utf8(F.col(text_col)).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
