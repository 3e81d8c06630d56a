"""Toxicity as severity grades: a cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import map_batches, slim
from tidewire.llm.labelled import labelled_sample
from tidewire.shared import materialize

WORDS = re.compile(r"\w+")
#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 2500
#: Severity grades above 0, and rows in which a feature must occur to be one.
GRADES, LEAST_ROWS = 3, 8
#: Standard errors by which a feature's shares of rows must differ between the labels.
LEAST_Z = 4.0
#: Probability of a grade above 0 from which a text counts as toxic.
REJECT_AT = 0.3


def features_of(word: str) -> tuple[str, ...]:
    """A lower-case word itself and, of longer words, its stems of 4 to 6 letters."""
    return (word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k))


def word_set(text: str) -> Counter:
    return Counter(WORDS.findall(text.lower()))


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(score - threshold[k]); one weight per feature for all thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, words: Counter, memo: dict) -> float:
        """Sum of the weights of the text's distinct features."""
        found = set()
        for word in words:
            own = memo.get(word)
            if own is None:
                if len(memo) > 500_000:
                    memo.clear()
                memo[word] = own = tuple(f for f in features_of(word) if f in self.weights)
            found.update(own)
        return sum(map(self.weights.__getitem__, sorted(found)))

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


FOUND = pa.schema([("feature", pa.string()), ("c0", pa.int64()), ("c1", pa.int64())])
NUMBERED = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("marked", pa.int64()), ("features", pa.list_(pa.int32()))])


def count_features(sample: DataFrame) -> DataFrame:
    """``(feature, c0, c1)``: in how many texts of ``sample(label, text)`` with each label a feature occurs, if in ``LEAST_ROWS``."""

    def run(batch: pa.RecordBatch) -> dict:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            seen[label].update({f for word in word_set(text) for f in features_of(word)})
        names = list(seen[0] | seen[1])
        return {"feature": names, "c0": [seen[0][f] for f in names], "c1": [seen[1][f] for f in names]}

    found = sample.select("text", "label").mapInArrow(map_batches(run, FOUND), "feature string, c0 long, c1 long")
    return found.groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where(F.col("c0") + F.col("c1") >= LEAST_ROWS)


def marked_features(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Features that occur in texts of label 1 many times oftener than in others."""
    return (c1 >= LEAST_ROWS) & (c1 / max(1, n1) > 20 * (c0 + 0.5) / max(1, n0))


def telling_features(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Features whose share of rows differs between the labels beyond chance."""
    mean = (c0 + c1) / (n0 + n1)
    error = np.sqrt(mean * (1 - mean) * (1 / n0 + 1 / n1))
    return np.abs(c1 / n1 - c0 / n0) >= LEAST_Z * error


def numbered(sample: DataFrame, marked: set[str], telling: list[str]) -> DataFrame:
    """``(doc_id, label, marked, features)``: how many marked words a text has, and the numbers of its telling features."""
    held = sample.sparkSession.sparkContext.broadcast((marked, {f: k for k, f in enumerate(telling)}))

    def run(batch: pa.RecordBatch) -> dict:
        marked, number = held.value
        counts, rows = [], []
        for text in batch.column("text").to_pylist():
            bag = word_set(text)
            own = {w: features_of(w) for w in bag}
            counts.append(sum(c for w, c in bag.items() if not marked.isdisjoint(own[w])))
            rows.append(sorted({number[f] for fs in own.values() for f in fs if f in number}))
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "marked": counts, "features": rows}

    sql = "doc_id long, label int, marked long, features array<int>"
    return sample.select("doc_id", "label", "text").mapInArrow(map_batches(run, NUMBERED), sql)


def severity_grades(labels: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Grades of labelled texts: 0 for label 0; for label 1 one marked word or none is grade 1, up to four grade 2, more grade 3."""
    return np.where(labels == 0, 0, np.select([marked <= 1, marked <= 4], [1, 2], 3))


def fit_ordinal(names: list[str], rows: list[np.ndarray], y: np.ndarray, grades: np.ndarray, rounds: int = 200) -> OrdinalModel:
    """Fit by proximal gradient steps on the ordinal likelihood; the L1 term keeps few features.

    ``rows`` has the numbers of each text's features among ``names``.
    """
    flat = np.concatenate(rows).astype(np.int64)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, theta = np.zeros(len(names)), np.arange(GRADES) + 1.0
    over = (grades[:, None] > np.arange(GRADES)[None, :]).astype(float)
    # Either label weighs half, whatever their numbers in the sample.
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())[:, None]
    square_w, square_t = np.full(len(names), 1e-8), np.full(GRADES, 1e-8)
    for _ in range(rounds):
        score = np.bincount(row_of, w[flat], minlength=len(rows))
        p = 1.0 / (1.0 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50)))
        slope = (p - over) * weight
        grad = np.bincount(flat, slope.sum(axis=1)[row_of], minlength=len(names))
        square_w += grad**2
        rate = 0.3 / np.sqrt(square_w)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * 1e-4, 0.0)
        grad_t = -slope.sum(axis=0)
        square_t += grad_t**2
        theta = np.maximum.accumulate(theta - 0.3 / np.sqrt(square_t) * grad_t)
    keep = np.abs(w) > 0.02
    return OrdinalModel({names[k]: float(w[k]) for k in np.flatnonzero(keep)}, theta)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> OrdinalModel:
    """The model of the bounded sample; the label column is ``toxic``.

    Texts stay on the executors: the driver gets the counts of features that occur in ``LEAST_ROWS`` texts of the
    sample, and then numbers. Without rows of both labels the model gives grade 0 to everything.
    """
    sample = materialize(labelled_sample(docs, labels, "toxic", per_class), "labelled-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return OrdinalModel({}, np.full(GRADES, 10.0))
    found = sorted(count_features(sample).collect())
    names = np.array([r["feature"] for r in found], object)
    c0, c1 = (np.array([r[c] for r in found], np.int64) for c in ("c0", "c1"))
    telling = names[telling_features(c0, c1, n0, n1)].tolist()
    rows = numbered(sample, set(names[marked_features(c0, c1, n0, n1)]), telling).orderBy("doc_id").collect()
    y = np.array([r["label"] for r in rows])
    grades = severity_grades(y, np.array([r["marked"] for r in rows]))
    return fit_ordinal(telling, [np.array(r["features"], np.int32) for r in rows], y, grades)


def _score(model: OrdinalModel, texts: list[str], memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity from 0 to 1, and the probability of any grade above 0."""
    scores = np.array([model.score(word_set(t), memo) for t in texts])
    above = model.at_least(scores) if len(texts) else np.zeros((0, GRADES))
    return above.sum(axis=1) / GRADES, above[:, 0]


SCORED = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, severity, p_toxic, toxic`` of every whole text, one row per input row.

    ``severity`` is the expected grade over the highest one, ``toxic`` says that a grade above 0 has a
    probability of ``REJECT_AT`` or more. A null or empty text has no feature and gets what the thresholds alone say. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        severity, above = _score(held.value, batch.column("text").to_pylist(), {})
        return {"doc_id": batch.column("doc_id"), "severity": severity, "p_toxic": above, "toxic": above >= REJECT_AT}

    return slim(docs, id_col, text_col).mapInArrow(
        map_batches(run, SCORED), "doc_id long, severity double, p_toxic double, toxic boolean"
    )


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, all columns and repeated rows kept, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(texts):
        import pandas as pd

        return pd.Series(_score(held.value, [t or "" for t in texts], {})[1] >= REJECT_AT)

    return docs.where(~rejected(F.col(text_col)))
