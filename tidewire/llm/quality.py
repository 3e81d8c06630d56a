"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import map_batches, slim
from tidewire.llm.labelled import held_out, labelled_sample

#: Labelled rows of each class that the model is fitted on, at most; words of a passage.
SAMPLE_PER_CLASS, PASSAGE_WORDS = 2500, 80
MARKS = re.compile(r"[^\w\s.,;:!?'\"()-]")
RUN = re.compile(r"([^\w\s])\1")
HIDDEN, HEADS = 12, 8


def passages(text: str) -> list[list[str]]:
    """Runs of ``PASSAGE_WORDS`` white-space separated words; every text has one at least."""
    words = text.split()
    return [words[k : k + PASSAGE_WORDS] for k in range(0, max(1, len(words)), PASSAGE_WORDS)]


def describe(words: list[str], before: set[str]) -> list[float]:
    """Surface features of a passage; ``before`` holds the words of the passages ahead of it."""
    n = len(words)
    if not n:
        return [0.0] * 13 + [1.0]
    line = " ".join(words)
    size = len(line)
    distinct = set(words)
    low = line.lower()
    return [
        len(distinct) / n,
        len(distinct & before) / len(distinct),
        size / n / 8.0,
        len(max(words, key=len)) / 20.0,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(len(w) <= 3 for w in words) / n,
        len(MARKS.findall(line)) / n,
        min(1.0, len(RUN.findall(line)) / n),
        (line.count(".") + line.count(",")) / n,
        line.count("!") / n,
        sum(map(low.count, "aeiou")) / size,
        min(n, PASSAGE_WORDS) / PASSAGE_WORDS,
    ]


def bag_of(text: str) -> np.ndarray:
    """A row of features per passage."""
    rows, before = [], set()
    for words in passages(text):
        rows.append(describe(words, before))
        before.update(words)
    return np.array(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class AttentionModel:
    """h = tanh(xE); attention ~ exp(tanh(hV) * sigmoid(hU) . w); score = sigmoid(sum of attention * h . c + b)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """All passages of ``n`` documents at once; ``bag`` names the document of each, ascending."""
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        raw = np.exp(np.clip((v * u) @ p["w"], -20, 20))
        share = raw / np.bincount(bag, raw, minlength=n)[bag]
        first = np.searchsorted(bag, np.arange(n))
        pooled = np.add.reduceat(share[:, None] * h, first)
        return {"z": z, "h": h, "v": v, "u": u, "share": share, "pooled": pooled, "y": sigmoid(pooled @ p["c"] + p["b"])}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return self.forward(np.concatenate(bags), bag, len(bags))["y"]


def fit_attention(bags: list[np.ndarray], labels: list[int], rounds: int = 200, seed: int = 7) -> AttentionModel:
    """Adam on the log loss of whole documents; passages have no labels, only a share of their document's."""
    n, d = len(bags), bags[0].shape[1] if bags else 14
    rng = np.random.default_rng(seed)
    p = {
        "E": rng.normal(0, d**-0.5, (d, HIDDEN)),
        "e": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, HEADS)),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, HEADS)),
        "w": rng.normal(0, HEADS**-0.5, HEADS),
        "c": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "b": np.zeros(1),
    }
    if not bags:
        return AttentionModel(np.zeros(d), np.ones(d), p | {"c": np.zeros(HIDDEN)})
    x = np.concatenate(bags)
    bag = np.repeat(np.arange(n), [len(b) for b in bags])
    y = np.array(labels, float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    model = AttentionModel(x.mean(axis=0), x.std(axis=0) + 1e-3, p)
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        f = model.forward(x, bag, n)
        miss = (f["y"] - y) * weight
        d_pooled = miss[:, None] * p["c"][None, :]
        d_h = f["share"][:, None] * d_pooled[bag]
        gain = (d_pooled[bag] * (f["h"] - f["pooled"][bag])).sum(axis=1) * f["share"]
        d_gate = gain[:, None] * p["w"][None, :]
        d_v = d_gate * f["u"] * (1 - f["v"] ** 2)
        d_u = d_gate * f["v"] * f["u"] * (1 - f["u"])
        d_h += d_v @ p["V"].T + d_u @ p["U"].T
        d_a = d_h * (1 - f["h"] ** 2)
        grad = {
            "E": f["z"].T @ d_a,
            "e": d_a.sum(axis=0),
            "V": f["h"].T @ d_v,
            "U": f["h"].T @ d_u,
            "w": (gain[:, None] * f["v"] * f["u"]).sum(axis=0),
            "c": f["pooled"].T @ miss,
            "b": miss.sum(keepdims=True),
        }
        for k in p:
            g = grad[k] + 1e-5 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g**2
            p[k] -= 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> AttentionModel:
    """The model of a bounded sample of the rows that are not held out; the label column is ``quality``."""
    sample = labelled_sample(docs, labels, "quality", per_class, ~held_out(F.col("doc_id")))
    # Passages are described on the executors; the driver gets their features only.
    described = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bag", pa.list_(pa.float32()))])

    def run(batch: pa.RecordBatch) -> dict:
        bags = [bag_of(t).ravel() for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "bag": bags}

    rows = sample.select("doc_id", "label", "text").mapInArrow(
        map_batches(run, described), "doc_id long, label int, bag array<float>"
    )
    rows = rows.orderBy("doc_id").collect()
    return fit_attention([np.array(r["bag"]).reshape(-1, 14) for r in rows], [r["label"] for r in rows])


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_quality(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, one row per input row.

    A null or empty text is one passage without words and has a score too. No shuffle; no column but the
    text enters a score. A null id is not held out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        bags = [bag_of(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "score": held.value.score(bags)}

    scored = slim(docs, id_col, text_col).mapInArrow(map_batches(run, SCORED), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
