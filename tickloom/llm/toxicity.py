"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features come from whole texts in one pass over Arrow batches. Besides a fixed lexicon there is one of word stems that
is learnt from a part of the labelled sample, for languages and spellings the fixed one misses. Trees and calibration
are Spark ML's, fitted on the rest of that bounded sample and applied to every row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import labelled_sample, sliced

#: The trees and the calibration are fitted on at most so many labelled documents.
FIT_DOCS = 20_000
TREES, DEPTH, SEED = 20, 3, 7
THRESHOLD = 0.7
#: Share of the trees' own probability in a score: it orders texts within one step of the calibration.
WITHIN_STEP = 0.01
#: Words around an insult in which a second-person pronoun counts as near.
NEAR = 3

# General insults, threats and pronouns in four languages.
INSULTS = frozenset(
    b"idiot idiots idiotic stupid moron morons moronic dumb dumbass loser losers clown clowns worthless pathetic trash garbage scum filth "
    b"disgusting vermin fool fools foolish imbecile cretin jerk creep pig pigs rat rats freak freaks liar liars coward cowards ugly useless "
    b"hate kill die bastard bitch bullshit crap damn hell shit fuck fucking asshole shut "
    b"idioten bloed dumm dummkopf arsch arschloch scheisse schwein versager abschaum trottel "
    b"idiote imbecile cretine connard salope merde nul ordure abruti debile "
    b"idiota imbecil estupido tonto basura mierda puta cabron inutil asqueroso".split()
)
YOU = frozenset(b"you your yours yourself u ur youre du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tuyo ustedes vosotros".split())
#: Bytes of a word's start that make a stem of the learnt lexicon, and what a stem needs to enter it.
STEMS, STEM_DOCS, STEM_RATIO, MAX_STEMS = (5, 6, 7), 8, 5.0, 4_000
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
_DISGUISED = re.compile(rb"[A-Za-z][A-Za-z]*[*@$!0-9][A-Za-z0-9*@$!]*[A-Za-z]")
_SPACED = re.compile(rb"\b(?:[A-Za-z][.\-_*]){2,}[A-Za-z]\b")
_LONG = re.compile(rb"([A-Za-z])\1{2,}")
#: Insults with one inner letter left out, as masked spellings are.
_SKELETONS = frozenset(w[:i] + w[i + 1 :] for w in INSULTS if len(w) > 3 for i in range(1, len(w) - 1)) - INSULTS - YOU

FEATURES = ["insults", "insult_kinds", "insults_long", "you", "you_near", "capitals", "shouted", "exclaimed", "symbols", "disguised", "stretched", "log_words", "stem_weight", "stem_hits", "stem_kinds"]


class Lexicon(dict):
    """Weights of words by their heaviest learnt stem; words seen are remembered up to a bound."""

    def __init__(self, stems: dict[bytes, float]):
        super().__init__()
        self.stems = stems

    def __missing__(self, word: bytes) -> float:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = max([self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k], default=0.0)
        return found


def features(text: bytes, lexicon: Lexicon) -> list[float]:
    """Densities and rates of one text; all 0 for a text without words."""
    plain = text.lower().translate(None, _PUNCTUATION).split()
    n = len(plain)
    if not n:
        return [0.0] * len(FEATURES)
    bad = np.flatnonzero(np.fromiter(map(INSULTS.__contains__, plain), bool, n))
    you = np.flatnonzero(np.fromiter(map(YOU.__contains__, plain), bool, n))
    near = 0
    if bad.size and you.size:
        at = np.searchsorted(you, bad)
        gap = np.minimum(np.abs(you[np.minimum(at, you.size - 1)] - bad), np.abs(you[np.maximum(at - 1, 0)] - bad))
        near = int((gap <= NEAR).sum())
    disguised = 0
    for token in _DISGUISED.findall(text) + _SPACED.findall(text):
        low = token.lower()
        bare = low.translate(None, _PUNCTUATION)
        disguised += bare not in INSULTS and (low.translate(_LEET, b"*.-_") in INSULTS or bare in _SKELETONS) or (bare in INSULTS and bare != low)
    letters = len(text.translate(None, bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122)))) or 1
    capitals = len(text.translate(None, bytes(b for b in range(256) if not 65 <= b <= 90)))
    weights = np.fromiter(map(lexicon.__getitem__, plain), float, n)
    hits = np.flatnonzero(weights)
    shouted = sum(map(bytes.isupper, text.split()))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>@"))
    return [
        100 * bad.size / n, float(len({plain[i] for i in bad})), float(np.log1p(bad.size)), 100 * you.size / n, 100 * near / n, capitals / letters,
        shouted / n, text.count(b"!") / n, symbols / n, 100 * disguised / n, len(_LONG.findall(text)) / n, float(np.log1p(n)),
        100 * float(weights.sum()) / n, 100 * hits.size / n, 100 * len({plain[i] for i in hits}) / n,
    ]


def learnt_stems(rows: DataFrame) -> dict[bytes, float]:
    """Log odds of the stems that toxic documents hold at STEM_RATIO times the rate of others; rows: text, toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in sliced(batches):
            for text, toxic in zip(pc.cast(batch.column("text"), pa.binary()).to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set((text or b"").lower().translate(None, _PUNCTUATION).split())
                seen[toxic].update({w[:k] for w in words for k in STEMS if len(w) >= k} | {b""})
        keys = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], ["stem", "clean", "toxic"])

    sums = rows.select("text", "toxic").mapInArrow(count, "stem binary, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = sums.filter(F.length("stem") == 0).head()  # the empty stem counts documents
    if total is None or not total["clean"] or not total["toxic"]:
        return {}
    ratio = (F.col("toxic") / F.lit(total["toxic"])) / ((F.col("clean") + 0.5) / F.lit(total["clean"]))
    best = sums.filter((F.col("toxic") >= STEM_DOCS) & (F.length("stem") > 0)).withColumn("ratio", ratio).filter(F.col("ratio") >= STEM_RATIO)
    return {bytes(r["stem"]): math.log(r["ratio"]) for r in best.orderBy(F.desc("toxic"), "stem").limit(MAX_STEMS).collect()}


def dense_features(docs: DataFrame, keep: list[str], stems: dict[bytes, float]) -> DataFrame:
    """keep and one double column per feature, for every row of docs; null texts count as empty."""
    kinds = dict(docs.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in sliced(batches):
            rows = [features(t or b"", lexicon) for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            columns = np.array(rows, float).reshape(-1, len(FEATURES)).T
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, columns)], [*keep, *(f"f_{f}" for f in FEATURES)])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"f_{f} double" for f in FEATURES)]))


def in_training(doc_id: str = "doc_id"):
    """False for the third of documents that is held out of all fitting."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


class ToxicityModel:
    """Trees and calibration; constant where the sample has no row or only one class."""

    def __init__(self, docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS):
        usable = F.col("toxic").isin(0, 1) & in_training()
        sample = labelled_sample(labels, usable, fit_docs, F.col("toxic"))
        found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        # One text for each doc_id, so that rows that repeat can't outgrow the bound.
        found = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(6))  # 0, 1: stems; 2, 3, 4: trees; 5: calibration
        self.stems = learnt_stems(found.filter(fold < 2))
        rows = self._vectors(dense_features(found.filter(fold >= 2), ["doc_id", "toxic"], self.stems)).withColumn("label", F.col("toxic").cast("double"))
        # One ordered partition of bounded size, so that every fit adds in the same order.
        rows = rows.select("doc_id", "label", "features").repartition(1).sortWithinPartitions("doc_id", "features").cache()
        try:
            share = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
            self.constant = share.get(1.0, 0) / max(1, sum(share.values())) if len(share) < 2 else None
            if self.constant is None:
                self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3, cacheNodeIds=False).fit(rows.filter(fold < 5))
                raw = self._raw(rows.filter(fold == 5))
                self.steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw) if raw.limit(1).count() else None
        finally:
            rows.unpersist()

    @staticmethod
    def _vectors(df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(df)

    def _raw(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(df).withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "features")

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """keep and ``score`` for every row of docs."""
        if self.constant is not None:
            return docs.select(*keep, F.lit(float(self.constant)).alias("score"))
        raw = self._raw(self._vectors(dense_features(docs, keep, self.stems)))
        if self.steps is None:
            return raw.select(*keep, F.col("raw").alias("score"))
        done = self.steps.setPredictionCol("step").transform(raw)
        step = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "step"))
        return done.select(*keep, ((1 - WITHIN_STEP) * step + WITHIN_STEP * F.col("raw")).alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text), learnt from labels(doc_id, toxic).

    Null and empty texts have all features 0 and get the score of such a text. Rows whose crc32(doc_id as text) mod 3
    is 1 are held out of the fit. A null doc_id is not held out. Labels other than 0 and 1 are ignored; without labels
    every score is 0, with one class its share. Repeated rows get equal scores; further columns are not read.
    """
    model = ToxicityModel(docs, labels, fit_docs)
    held = F.coalesce(~in_training(), F.lit(False))
    return model.score(docs, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
