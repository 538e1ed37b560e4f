"""The corpus pipeline: toxicity, near copies, personal data, mixing and packing, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import jaccard_join, mixing, packing, pii, toxicity
from tickloom.llm.common import bound_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No stage but the last can be said in SQL as a whole; the tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score stays below the threshold."""
    bound_batches(spark)
    model = toxicity.ToxicityModel(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, COLUMNS).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component, that with the least doc_id; texts without words stay."""
    bound_batches(spark)
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars follows the new text."""
    bound_batches(spark)
    kind = docs.schema["n_chars"].dataType
    return pii.redact_all(docs, COLUMNS).withColumn("n_chars", F.length("text").cast(kind)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes; a source's last copy holds only the words that still fit."""
    bound_batches(spark)
    return mixing.mixed_rows(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in their sequences."""
    bound_batches(spark)
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet in the shared folder and read again."""
    from tickloom.llm.common import shared_folder

    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return done
        done.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    raise AssertionError
