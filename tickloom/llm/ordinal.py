"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - theta_k) with one weight vector over hashed words and word shapes for all grades and
ordered thresholds theta. A document's expected grade and the probability of at least a wanted grade come from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the features, and the most labelled documents that the model is fitted on.
BITS, FIT_DOCS = 13, 8_000
EPOCHS, RATE, RIDGE = 150, 0.1, 1e-4
#: The tail is P(grade >= TAIL_GRADE); documents are kept from TAIL_PROBABILITY up.
TAIL_GRADE, TAIL_PROBABILITY = 1, 0.5
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Letters by case, digits as one, other bytes of UTF-8 as lower case.
_SHAPE = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and values: half of the unit length is for words, half for the shapes of their ends."""
    words = text.lower().translate(None, _PUNCTUATION).split()
    shapes = [s[:2] + s[-3:] for s in text.translate(_SHAPE).split()]
    if not shapes:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    sums = np.zeros(1 << BITS)
    for salt, parts in ((0, words), (1 << 31, shapes)):
        if parts:
            h = np.fromiter(map(crc32, parts), np.uint32, len(parts)) ^ np.uint32(salt)
            own = np.sqrt(np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS))
            sums += own / np.sqrt(2 * (own**2).sum())
    at = np.flatnonzero(sums)
    return at.astype(np.int32), sums[at].astype(np.float32)


def _tails(score: np.ndarray, thetas: np.ndarray) -> np.ndarray:
    """P(grade > k) by row and k; steep values are clipped."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thetas, -35, 35)))


def fit(grades: np.ndarray, starts: np.ndarray, buckets: np.ndarray, values: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and levels - 1 ordered thresholds, by Adam on the mean log likelihood; rows of x lie from starts on."""
    rows = np.repeat(np.arange(len(grades)), np.diff(starts))
    above = (grades[:, None] > np.arange(levels - 1)).mean(axis=0).clip(1e-3, 1 - 1e-3)
    first = np.maximum.accumulate(-np.log(above / (1 - above)))
    # The gaps between thresholds are exponentials, so that they stay ordered.
    params = np.concatenate([np.zeros(1 << BITS), first[:1], np.log(np.diff(first) + 1e-2)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, EPOCHS + 1):
        w, raw = params[: 1 << BITS], params[1 << BITS :]
        thetas = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        score = np.bincount(rows, w[buckets] * values, len(grades))
        ends = np.hstack([np.ones((len(grades), 1)), _tails(score, thetas), np.zeros((len(grades), 1))])
        at = np.arange(len(grades))
        upper, lower = ends[at, grades], ends[at, grades + 1]
        p = np.maximum(upper - lower, 1e-12)
        # d log p / d score; thresholds below and above the grade get their own parts.
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_score = (du - dl) / len(grades)
        d_theta = np.array([(dl[grades == k].sum() - du[grades == k + 1].sum()) / len(grades) for k in range(levels - 1)])
        d_raw = np.concatenate([[d_theta.sum()], np.exp(raw[1:]) * np.cumsum(d_theta[::-1])[::-1][1:]])
        gradient = np.concatenate([np.bincount(buckets, values * d_score[rows], 1 << BITS) - RIDGE * w, d_raw])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = params[1 << BITS :]
    return params[: 1 << BITS], np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def train(docs: DataFrame, graded: DataFrame, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Fit on docs that are in graded(doc_id, grade), a frame of bounded size; without any, all grades are as likely."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or b"") for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([b for _, b in found], pa.list_(pa.float32()))], ["doc_id", "grade", "at", "value"])

    def fit_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame(columns=["grade", "at", "value"])])
        if len(rows):
            starts = np.concatenate([[0], np.cumsum(rows["at"].map(len))])
            w, thetas = fit(rows["grade"].to_numpy(int), starts, np.concatenate(rows["at"].tolist()).astype(int), np.concatenate(rows["value"].tolist()).astype(float), levels)
            yield pd.DataFrame({"k": np.arange(len(w) + len(thetas)), "x": np.concatenate([w, thetas])})

    found = docs.select("doc_id", "text").join(F.broadcast(graded.select("doc_id", F.col("grade").cast("int"))), "doc_id")
    # One text for each doc_id, so that rows that repeat can't outgrow the bound.
    found = found.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    kind = docs.select("doc_id").dtypes[0][1]
    sample = found.mapInArrow(vectors, f"doc_id {kind}, grade int, at array<int>, value array<float>")
    params = sample.repartition(1).sortWithinPartitions("doc_id", "grade", "at").mapInPandas(fit_all, "k int, x double").toPandas().sort_values("k")["x"].to_numpy()
    if not len(params):
        return np.zeros(1 << BITS), -np.log((levels - 1 - np.arange(levels - 1)) / (np.arange(levels - 1) + 1.0))
    return params[: 1 << BITS], params[1 << BITS :]


def grade_documents(docs: DataFrame, graded: DataFrame, levels: int, tail_grade: int = TAIL_GRADE, tail_probability: float = TAIL_PROBABILITY) -> DataFrame:
    """doc_id, expected_grade, tail_probability and kept of every row of docs(doc_id, text).

    Grades are 0 to levels - 1; graded(doc_id, grade) must be of bounded size. Null and empty texts have no features
    and get what the thresholds alone say. Repeated rows get equal results, empty tables empty ones; without graded
    documents every grade is as likely. Other columns are not read.
    """
    weights, thetas = train(docs, graded, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or b"") for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            tails = _tails(np.array([float(weights[at] @ value) for at, value in found]), thetas)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, tail_grade - 1])], ["doc_id", "expected_grade", "tail_probability"])

    kind = docs.select("doc_id").dtypes[0][1]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= tail_probability)
