"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over hashed word 1-grams and 2-grams are counted: one over every text of the corpus, one over
trusted documents. A document's score is the mean log ratio of its n-grams; it is kept from a fixed threshold up.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES

#: Hash buckets of both multinomials: 2 ** BITS numbers go to the driver and back, at any corpus size.
BITS = 16
#: Added to every bucket's count, as a share of the mean count of a bucket.
SMOOTHING = 0.5
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.15
#: The trusted multinomial is fitted on at most so many labelled documents.
TARGET_DOCS = 20_000
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"

RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def gram_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of a text's 1-grams, then of its 2-grams."""
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    pairs = (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F))
    return np.concatenate([h * np.uint32(0xC2B2AE3D), pairs]) >> np.uint32(32 - BITS)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice, by exact comparison."""
    n = len(words) - 2
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:  # three numbers no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:n] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return pc.cast(batch.column("text"), pa.binary()).to_pylist()


def gram_counts(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Rows raw and trusted of counts by bucket, over whole texts of all docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            marked = zip(_texts(batch), batch.column("trusted").to_pylist(), strict=True)
            grams = [(gram_buckets(words), good) for text, good in marked if (words := (text or b"").split())]
            for into, own in ((raw, [g for g, _ in grams]), (target, [g for g, good in grams if good])):
                if own:
                    into += np.bincount(np.concatenate(own), minlength=1 << BITS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id", F.lit(True).alias("trusted"))), "doc_id", "left")
    sums = (
        marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        .mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    counts = np.zeros((2, 1 << BITS))
    counts[:, sums["bucket"].to_numpy(np.int64)] = sums[["raw", "target"]].to_numpy().T
    return counts


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | raw); all 0 where nothing is trusted or nothing was counted."""
    if not counts.sum(axis=1).all():
        return np.zeros(counts.shape[1])
    # The same pseudo-distribution, in proportion to the raw one, smooths both: unseen n-grams count 0.
    raw, target = counts
    base = (raw + SMOOTHING * raw.mean()) / (raw.sum() * (1 + SMOOTHING))
    prior = SMOOTHING * raw.shape[0]
    return np.log((target + prior * base) / (target.sum() + prior)) - np.log(base)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): base counts, the score and the verdict.

    trusted(doc_id) must be of bounded size; it is broadcast. Null and empty texts have no words, score 0 and fail the
    base rule. Repeated rows are judged each on its own (and counted each in the raw corpus). An empty table gives an
    empty result; without trusted documents all scores are 0, and the base rules alone decide. Other columns of docs
    are neither read nor returned.
    """
    ratios = log_ratios(gram_counts(docs, trusted))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, points in zip(_texts(batch), pc.utf8_length(batch.column("text")).to_pylist(), strict=True):
                raw = text or b""
                words = raw.split()
                lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
                repeated = repeated_words(words)
                failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
                score = float(ratios[gram_buckets(words)].mean()) if words else 0.0
                spaces = len(raw) - len(raw.translate(None, SPACES))
                out.append((len(words), (points or 0) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, score, not failed and score >= threshold))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()], strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], [c.split()[0] for c in RULES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, RULES)
