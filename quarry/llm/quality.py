"""Quality scores from two zstandard dictionaries, one of good and one of bad labelled text.

Feature: bytes that the whole text takes with the bad dictionary less those with the good one, for each byte of
text. A logistic curve, fitted on labelled rows that gave nothing to the dictionaries, makes a probability of it.

Defined results: null and empty texts have feature 0 and the score of that; if labels of one class are missing, or
texts for them, every score is the share of good labels, at least 0.01 and at most 0.99 (0.5 without any label). Labels that are
neither 0 nor 1 are not used. Long texts count whole, piece by piece. Rows keep their multiplicity, ties have equal scores; an empty
table gives no rows; ids, languages, sources and columns with other names are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import in_batches, tidy
from quarry.llm.compression import compressor, dictionary, labelled_sample, sizes
from quarry.llm.langid import fold

#: From this score on a document counts as good.
THRESHOLD = 0.3
#: Bytes of a dictionary; labelled rows of each class that are sampled at most and bytes of them that are enough, half for it and half to
#: calibrate.
SIZE = 1 << 21
ROWS, SAMPLED = 4000, 2 * SIZE


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def feature(text: str | None, compressors: list) -> float:
    data = (text or "").encode()
    if not data:
        return 0.0
    good, bad = sizes(data, compressors)
    return (bad - good) / len(data)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a slight pull to 0 that keeps separable data finite."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g = weight * (p - y)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * x).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -20, 20), b - np.clip(step[1], -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """``labels``: ``doc_id, quality`` of the rows to learn from."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    counts = {r[0]: r[1] for r in labels.groupBy("quality").count().collect()}
    share = min(max(counts.get(1, 0) / sum(counts.values()), 0.01), 0.99) if counts else 0.5
    constant = Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    if len(counts) < 2:
        return constant
    sample = labelled_sample(docs, labels, "doc_id", "quality", rows, SAMPLED)
    texts: dict[int, list[str]] = {0: [], 1: []}
    for _, text, quality in sample:
        texts[quality].append(text)
    texts = {q: list(dict.fromkeys(ts)) for q, ts in texts.items()}
    if not all(texts.values()):  # labels, but no texts of a class
        return constant
    made = {q: dictionary(ts[::2], SIZE) for q, ts in texts.items()}
    compressors = [compressor(made[1]), compressor(made[0])]
    rest = [(feature(t, compressors), q, counts[q] / max(1, len(ts[1::2]))) for q, ts in texts.items() for t in ts[1::2]]
    if len({q for _, q, _ in rest}) < 2:  # too few to calibrate apart from the dictionaries
        rest = [(feature(t, compressors), q, counts[q] / len(ts)) for q, ts in texts.items() for t in ts]
    x, y, w = (np.array(v, float) for v in zip(*rest, strict=True))
    slope, intercept = logistic(x * 10, y, w * len(w) / w.sum())
    return Model(made[1], made[0], slope * 10, intercept)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = [compressor(model.good), compressor(model.bad)]
        for batch in batches:
            x = np.array([feature(t, compressors) for t in batch.column(1).to_pylist()], float)
            p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -500, 500)))
            columns = [batch.column(0), pa.array(p), pa.array((p >= threshold).astype("i4"))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return in_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels whose fold of five is not 0, score all documents; ``held_out`` marks fold 0."""
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
