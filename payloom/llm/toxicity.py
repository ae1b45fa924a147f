"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct words (A-Z lower-cased, letters, digits and non-ASCII characters), hashed into
2^`BITS` columns; columns in fewer than `LEAST` training texts weigh nothing. The machine scores w0 + the sum of w + the
sum over all pairs of terms of the product of their factor vectors; the pairs are what a linear model misses (an insult
near a group's name). It is fitted on logistic loss on the driver, the linear part by follow-the-regularised-leader
with a sparse penalty, the factors by AdaGrad with a penalty of their own that shrinks whole vectors to nil, whatever the column's
weight, so a word that says nothing alone can be in a pair (if `PAIR_LEAST` texts and `PAIR_SHARE` of all have it). A column is dropped only if its weight and its factors are nil. Fitting takes at most `SAMPLE` labelled rows (the documented
bound; those with the smallest hash of the id), whose hashed terms alone are collected. The last `HOLD` part of the
sample fits a logistic calibration of the machine's output.

Scores: one pass over the documents, without shuffle; the model has the columns that the penalties kept, a share of
those in the bounded sample, and is broadcast. Of rows that repeat an id the one with the smallest columns counts.

Defined results: null and wordless texts have no terms and score the calibrated bias; rows without a label or with a null label train nothing;
repeated documents each get their row; with no labelled rows, or of one class only, every score is the share of toxic
labels (0 with none). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom.llm.common import ALNUM_TABLE, release, remainder, slices, table, utf8

BITS = 26
FACTORS = 4
#: Labelled rows that training takes at most.
SAMPLE = 20_000
EPOCHS = 12
BATCH = 64
HOLD = 0.2
#: Training texts that a column must be in to weigh anything.
LEAST = 3
#: Strength of the sparse penalty of the linear part.
SPARSE = 4.0
#: Strengths of the penalties on a column's factor vector: what it loses of its length, and of its square, at each step.
SHRINK, RIDGE = 0.1, 0.05
#: Training texts, and share of them, that a column must be in to have factors: pairs of rarer ones can't be told from chance.
PAIR_LEAST, PAIR_SHARE = 50, 0.01
SEED = 7
THRESHOLD = 0.3
MODULUS, HELD = 4, 2
#: Words whose column a worker remembers at most.
CACHE = 100_000


class Terms(dict):
    """Maps a word to its hashed column."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        column = self[word] = zlib.crc32(word) & (1 << BITS) - 1
        return column

    def of(self, text: bytes | None) -> np.ndarray:
        """The distinct columns of a text."""
        words = set((text or b"").translate(ALNUM_TABLE).split())
        return np.unique(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))


@dataclass
class Machine:
    """columns: the hashed columns that weigh something, in order; linear and factors: their parameters."""

    bias: float
    columns: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def raw(self, columns: np.ndarray) -> float:
        """What the machine says of a text's distinct columns."""
        if not len(columns) or not len(self.columns):
            return self.bias
        at = np.searchsorted(self.columns, columns)
        at[at == len(self.columns)] = 0
        at = at[self.columns[at] == columns]
        v = self.factors[at]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[at].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, columns: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(columns) + self.offset, -40, 40))))


def calibrate(raw: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic fit, with slightly smoothed targets, by Newton's method."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = raw.std() or 1.0
    z = (raw - raw.mean()) / spread
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / spread, b - a * raw.mean() / spread


def fit(rows: list[np.ndarray], labels: np.ndarray, *, epochs: int = EPOCHS, alpha: float = 0.2, sparse: float = SPARSE, rate: float = 0.05) -> Machine:
    """Fit a machine on lists of columns and 0/1 labels, in the given order."""
    y = np.asarray(labels, np.float64)
    n_fit = len(y) - int(len(y) * HOLD)
    if not len(y) or len(set(y.tolist())) < 2 or len(set(y[:n_fit].tolist())) < 2:
        return Machine(0, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)), constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(SEED)
    columns, times = np.unique(np.concatenate(rows[:n_fit]), return_counts=True)
    columns, times = columns[times >= LEAST], times[times >= LEAST]
    given, rows = rows, [np.searchsorted(columns, r[np.isin(r, columns, assume_unique=True)]) for r in rows[:n_fit]]
    may_pair = times >= max(PAIR_LEAST, PAIR_SHARE * n_fit)
    w, z, n = np.zeros(len(columns)), np.zeros(len(columns)), np.zeros(len(columns))
    v, gv = rng.normal(0, 0.01, (len(columns), FACTORS)) * may_pair[:, None], np.full((len(columns), FACTORS), 1e-2)
    share = y[:n_fit].mean()
    bias, gb = float(np.log(share / (1 - share))), 1.0
    for epoch in range(epochs):
        order = rng.permutation(n_fit)
        for at in range(0, n_fit, BATCH):
            some = order[at : at + BATCH]
            sizes = np.array([len(rows[i]) for i in some])
            cols = np.concatenate([rows[i] for i in some])
            seg = np.repeat(np.arange(len(some)), sizes)
            total = np.stack([np.bincount(seg, v[cols, k], len(some)) for k in range(FACTORS)], axis=1)
            square = np.bincount(seg, (v[cols] ** 2).sum(axis=1), len(some))
            raw = bias + np.bincount(seg, w[cols], len(some)) + 0.5 * ((total * total).sum(axis=1) - square)
            g = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[some]
            if len(cols):
                uniq, place = np.unique(cols, return_inverse=True)
                dw = np.bincount(place, g[seg], len(uniq))
                sigma = (np.sqrt(n[uniq] + dw * dw) - np.sqrt(n[uniq])) / alpha
                z[uniq] += dw - sigma * w[uniq]
                n[uniq] += dw * dw
                w[uniq] = np.where(np.abs(z[uniq]) <= sparse, 0, -(z[uniq] - np.sign(z[uniq]) * sparse) / ((1 + np.sqrt(n[uniq])) / alpha))
            lc, ls = cols[may_pair[cols]], seg[may_pair[cols]]
            if len(lc):
                uniq, place = np.unique(lc, return_inverse=True)
                each = g[ls][:, None] * (total[ls] - v[lc])
                dv = np.stack([np.bincount(place, each[:, k], len(uniq)) for k in range(FACTORS)], axis=1) + RIDGE * v[uniq]
                gv[uniq] += dv * dv
                v[uniq] -= rate * dv / np.sqrt(gv[uniq])
                if epoch >= epochs // 3:  # pairs may form first
                    length = np.sqrt((v[uniq] ** 2).sum(axis=1))
                    v[uniq] *= np.maximum(0, 1 - rate * SHRINK / np.maximum(length, 1e-12))[:, None]
            gb += g.sum() ** 2
            bias -= 0.5 * alpha * g.sum() / np.sqrt(gb)
    kept = (w != 0) | (v != 0).any(axis=1)
    model = Machine(bias, columns[kept], w[kept], v[kept])
    raw = np.array([model.raw(r) for r in given[n_fit:]])
    if len(set(y[n_fit:].tolist())) == 2:
        model.slope, model.offset = calibrate(raw, y[n_fit:])
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", modulus: int = MODULUS, held: int = HELD, sample: int = SAMPLE) -> Machine:
    """Fit on labelled rows outside the held-out part, `sample` at most."""
    named = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).where(remainder(F.col(label_id_col), modulus) != held)
    named = named.groupBy(F.col(label_id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("body"))
    joined = texts.join(F.broadcast(chosen), "id").select("id", "label", "body")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in slices(batches):
            rows = [terms.of(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), pa.array(rows, pa.binary())], ["id", "label", "columns"])

    rows = joined.mapInArrow(hashed, "id string, label int, columns binary")
    got = rows.groupBy("id").agg(F.max("label").alias("label"), F.min("columns").alias("columns")).toPandas()
    got["order"] = [zlib.crc32(str(i).encode()) for i in got["id"]]
    got = got.sort_values(["order", "id"])
    model = fit([np.frombuffer(c, np.int32) for c in got["columns"]], got["label"].to_numpy())
    del got
    release()
    return model


def score(docs: DataFrame, model: Machine, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id and score of every document. carry: the documents' columns as a struct `row`, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row") if carry else F.col(id_col).alias("row"), utf8(F.col(text_col)).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, machine = Terms(), shared.value
        for batch in slices(batches):
            scores = [machine.score(terms.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    schema = rows.select("row", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Machine, *, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """The documents that score under the threshold; their columns as they are."""
    return score(docs, model, carry=True, **columns).where(F.col("score") < threshold).select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("row").alias("doc_id"), (remainder(F.col("row"), MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
