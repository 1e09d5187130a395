"""Quality scores from a naive Bayes support vector machine.

Features are indicators of byte n-grams, hashed to a fixed width. Each is scaled by the log ratio of its smoothed
frequencies in the two classes; a linear model with hinge loss is fitted to the scaled indicators by dual
coordinate descent. A text's margin, the sum of its weights, is divided by the root of its number of n-grams, so that
long texts do not score higher for their length, and a logistic fit maps what results to 0..1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import narrowed

BITS = 17


def features(raw: bytes, seen: np.ndarray) -> np.ndarray:
    """Distinct hashed 2- and 3-grams of bytes. seen: an int32 work array of 2^BITS."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    parts = []
    for k in (2, 3):
        if len(b) >= k:
            h = np.full(len(b) - k + 1, k, np.uint32)
            for i in range(k):
                h = h * np.uint32(257) + b[i : len(b) - k + 1 + i]
            parts.append((h * np.uint32(2654435769)) >> np.uint32(32 - BITS))
    if not parts:
        return np.zeros(0, np.int32)
    x = np.concatenate(parts).astype(np.int32)
    at = np.arange(len(x), dtype=np.int32)
    seen[x] = at
    return x[seen[x] == at]


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int) -> np.ndarray:
    """Weights of a hinge-loss model on ratio-scaled indicators; y is -1 or 1. Each step solves one dual variable."""
    w = np.zeros(len(ratio))
    alpha = np.zeros(len(rows))
    squares = np.array([np.square(ratio[x]).sum() for x in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if squares[i] == 0:
                continue
            x = rows[i]
            gradient = y[i] * (w[x] * ratio[x]).sum() - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), cost)
            if new != alpha[i]:
                w[x] += (new - alpha[i]) * y[i] * ratio[x]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w * ratio


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float) -> np.ndarray:
    """Log of each indicator's smoothed frequency in class 1 over that in class -1."""
    counts = np.full((2, 1 << BITS), smooth)
    for k in (0, 1):
        if mine := [x for x, v in zip(rows, y, strict=True) if (v > 0) == k]:
            counts[k] += np.bincount(np.concatenate(mine), minlength=1 << BITS)
    n = np.array([(y < 0).sum(), (y > 0).sum()]) + 2 * smooth
    return np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that map margins to the chance of class 1, by Newton steps with smoothed targets."""
    ones = (y > 0).sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


@dataclass
class Model:
    """weights: of the indicators; slope and offset: from margin to score."""

    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        seen = np.zeros(1 << BITS, np.int32)
        margin = np.array([self.weights[x].sum() / max(1.0, np.sqrt(len(x))) if len(x := features((t or "").encode(), seen)) else 0.0 for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def train_rows(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: those whose crc32(doc_id as text) mod 4 is not 2, one per document."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    return rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg(F.max("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 6000, cost: float = 0.5, rounds: int = 12, smooth: float = 1.0, seed: int = 7) -> Model:
    """A model from at most ``max_fit_rows`` labelled documents, those with the smallest hash of their id.

    docs: doc_id and text; labels: doc_id and label (0 or 1), one per id. Of rows with one id the smallest text counts. A
    text has at most 2 ** BITS indicators of 4 bytes, however long it is. The bound keeps what is gathered here the same at
    every size of corpus. With rows of one class only, or none, every score is that class's smoothed share.
    """
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most max_fit_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int32)
        for b in batches:
            x = [np.sort(features((t or "").encode(), seen)).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {id_type}, label int, x binary").orderBy("doc_id", "x").toArrow()
    y = np.array(got["label"].to_pylist(), int) * 2 - 1
    rows = [np.frombuffer(x, "<i4") for x in got["x"].to_pylist()]
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS), 1.0, float(np.log(share / (1 - share))))
    norm = [max(1.0, np.sqrt(len(x))) for x in rows]
    # three folds, each with log ratios and a model of the other two, give the margins that the logistic fit sees
    fold, margin = np.arange(len(rows)) % 3, np.zeros(len(rows))
    for k in range(3):
        own = np.flatnonzero(fold != k)
        others = [rows[i] for i in own]
        w = descend(others, y[own], log_ratios(others, y[own], smooth), cost, rounds, seed)
        for i in np.flatnonzero(fold == k):
            margin[i] = w[rows[i]].sum() / norm[i]
    weights = descend(rows, y, log_ratios(rows, y, smooth), cost, rounds, seed)
    return Model(weights, *logistic(margin, y))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every row.

    Only the text is scored. Rows of ``labels`` with a null id or label are left out, the larger label counts where
    a document has several, and labels without a document are ignored. Null and empty texts get the model's score
    of a text without n-grams. A null id is not held out. Repeated rows each get their score; no rows give none. Texts
    of any length are read whole, one at a time.
    """
    own = narrowed(docs, doc_id=doc_id, text=text)
    model = fit(own, train_rows(labels, label), **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column("text").to_pylist()))], names=["doc_id", "score"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    scored = own.mapInArrow(run, f"doc_id {id_type}, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; see quality_scores.

    Null and empty texts are judged by the score of a text without n-grams. Rows with equal texts are kept or dropped
    alike, repeated rows and null ids too; an empty table stays empty. Column names of docs are free, also ``score``.
    """
    model, at = fit(narrowed(docs, doc_id=doc_id, text=text), train_rows(labels, label), **settings), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
