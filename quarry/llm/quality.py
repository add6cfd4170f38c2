"""Ordinal quality: cumulative-link regression on graded ratings.

One weight vector over hashed words and a few shape features is shared by all
grades; ordered thresholds part them: P(grade <= k) = sigmoid(t_k - w x).
Scoring gives the expected grade and the tail probability P(grade >= g).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words

BUCKETS = 1 << 16
#: Labelled documents that a model is fitted on, and their UTF-8 bytes, at most about.
TRAIN_DOCS, TRAIN_BYTES = 6_000, 32 << 20
SHAPES = 9
EPOCHS = 40


def shapes(names: list[str], index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shape features of each text: what share of its words repeats, is marks only, ends a sentence, and so on."""
    n = np.maximum(np.diff(bounds), 1).astype(float)
    per = np.array([(not any(map(str.isalnum, w)), w[-1:] in ".!?", any(map(str.isdigit, w)), w[:1].isupper(), min(len(w), 40) / 10) for w in names] or np.zeros((0, 5)), np.float32)
    means = words.sums(per, index, bounds) / n[:, None]
    same = np.zeros(len(index))
    same[1:] = index[1:] == index[:-1]
    starts = bounds[:-1][bounds[:-1] < len(index)]
    same[starts] = 0
    again = words.sums(same[:, None], np.arange(len(index)), bounds)[:, 0] / n
    distinct = np.zeros(len(n))
    owner = np.repeat(np.arange(len(n)), np.diff(bounds))
    pairs = np.unique(owner.astype(np.int64) * max(len(names), 1) + index)
    np.add.at(distinct, pairs // max(len(names), 1), 1)
    log_n = np.log1p(np.diff(bounds)) / 10
    return np.column_stack([means, again, distinct / n, log_n, (np.diff(bounds) == 0).astype(float)])


class OrdinalModel:
    """Weights, thresholds and the grades they part; *mean* and *spread* standardise the shapes."""

    def __init__(self, grades: np.ndarray):
        self.grades = np.asarray(grades, float)
        self.hashed = np.zeros(BUCKETS)
        self.shape = np.zeros(SHAPES)
        self.mean, self.spread = np.zeros(SHAPES), np.ones(SHAPES)
        self.thresholds = np.linspace(-1, 1, len(self.grades) - 1) if len(self.grades) > 2 else np.zeros(max(0, len(self.grades) - 1))

    def _latent(self, x: np.ndarray, buckets: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(bounds), 1)
        return words.sums(self.hashed[buckets][:, None], index, bounds)[:, 0] / np.sqrt(n) + ((x - self.mean) / self.spread) @ self.shape

    def probabilities(self, latent: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(np.clip(latent[:, None] - self.thresholds, -40, 40)))
        edge = np.ones((len(latent), 1))
        return np.diff(np.concatenate([0 * edge, below, edge], 1), axis=1)

    def fit(self, texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> OrdinalModel:
        """Full-batch gradient steps with Adagrad; thresholds stay in order as a first one and positive gaps."""
        names, index, bounds = _one(texts)
        buckets = np.array([words.hash32(w.lower()) % BUCKETS for w in names], np.int64)
        x = shapes(names, index, bounds)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.spread
        y = np.searchsorted(self.grades, labels)
        if len(self.grades) < 2:
            return self
        weight = 1 / np.maximum(np.bincount(y, minlength=len(self.grades)), 1)[y]
        weight *= len(y) / weight.sum()
        scale = 1 / np.sqrt(np.maximum(np.diff(bounds), 1))
        owner = np.repeat(np.arange(len(y)), np.diff(bounds))
        memory_w, memory_s, memory_t = np.full(BUCKETS, 1e-8), np.full(SHAPES, 1e-8), np.full(len(self.thresholds), 1e-8)
        for _ in range(epochs):
            latent = self._latent(x, buckets, index, bounds)
            below = 1 / (1 + np.exp(np.clip(latent[:, None] - self.thresholds, -40, 40)))
            edge = np.ones((len(y), 1))
            full = np.concatenate([0 * edge, below, edge], 1)
            slope = full * (1 - full)
            rows = np.arange(len(y))
            p = np.maximum(full[rows, y + 1] - full[rows, y], 1e-9)
            # of -log p, by the latent value and by each threshold
            by_latent = weight * (slope[rows, y + 1] - slope[rows, y]) / p / len(y)
            by_t = np.zeros(len(self.thresholds) + 2)
            np.add.at(by_t, y + 1, -weight * slope[rows, y + 1] / p / len(y))
            np.add.at(by_t, y, weight * slope[rows, y] / p / len(y))
            by_t = by_t[1:-1]
            g_w = np.bincount(buckets[index], (by_latent * scale)[owner], BUCKETS) + decay * self.hashed
            g_s = z.T @ by_latent + decay * self.shape
            gaps = np.concatenate([self.thresholds[:1], np.log(np.maximum(np.diff(self.thresholds), 1e-6))])
            g_gap = np.concatenate([[by_t.sum()], np.cumsum(by_t[::-1])[::-1][1:] * np.diff(self.thresholds)])
            for value, g, memory in ((self.hashed, g_w, memory_w), (self.shape, g_s, memory_s), (gaps, g_gap, memory_t)):
                memory += g * g
                value -= rate * g / np.sqrt(memory)
            self.thresholds = gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])
        return self

    def score(self, texts: pa.Array, grade: float) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= *grade*) of each text."""
        expected, tail = [], []
        for _, _, names, index, bounds in words.batches_of_words(texts):
            buckets = np.array([words.hash32(w.lower()) % BUCKETS for w in names], np.int64)
            p = self.probabilities(self._latent(shapes(names, index, bounds), buckets, index, bounds))
            expected.append(p @ self.grades)
            tail.append(p[:, self.grades >= grade].sum(1))
        return (np.concatenate(expected), np.concatenate(tail)) if expected else (np.zeros(0), np.zeros(0))


def _one(texts: pa.Array):
    """All *texts* in one pass: they are a bounded sample."""
    from quarry.llm import chunk_tokens

    names, index, bounds = chunk_tokens.split(texts)
    return names.to_pylist(), index, bounds


def fit(docs: DataFrame, labels: DataFrame, *, grade_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> OrdinalModel:
    """A model of the graded ids in *labels*, fitted on at most about *train_docs* of them with *train_bytes* bytes of text.

    Null grades and ids teach nothing, a null text counts as empty.  Of one grade only, or none, the
    model gives that grade (0 without any) with probability 1.
    """
    graded = words.sample(labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(grade_col).cast("double").alias("grade")), train_docs, "id")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = words.collected(texts.join(F.broadcast(graded), "id"), train_bytes)
    grade = np.asarray(rows["grade"], float)
    model = OrdinalModel(np.unique(grade) if len(grade) else np.zeros(1))
    return model.fit(words.one_array(rows, "text"), grade) if len(grade) else model


def predict(docs: DataFrame, model: OrdinalModel, *, grade: float = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of *docs*: doc_id, expected_grade, tail_probability = P(grade >= *grade*), selected = tail_probability >= *least*.

    A null text counts as empty.  Repeated rows give a row each, an empty table
    none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            expected, tail = shared.value.score(batch.column("text"), grade)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected), pa.array(tail), pa.array(tail >= least)], names=["doc_id", "expected_grade", "tail_probability", "selected"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, selected boolean")
