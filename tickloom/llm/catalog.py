"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import centroids, html_main, jaccard_join, mixing, ordinal, packing, pii, prefix_trie, quality_llr, secret_scan, tiff, toxicity, url_filter
from tickloom.llm.common import bound_batches, labelled_sample, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = labelled_sample(table(spark, sf_dir, "labels"), F.col("quality") == 1, quality_llr.TARGET_DOCS)
    return quality_llr.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 of low quality, 1 of high quality but toxic, 2 of high quality and not toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    usable = F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)
    graded = labelled_sample(table(spark, sf_dir, "labels"), usable, ordinal.FIT_DOCS, grade.alias("grade"))
    return ordinal.grade_documents(table(spark, sf_dir, "documents"), graded, 3)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_images(table(spark, sf_dir, "documents"))


def op9_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_pii,
        op3_ordinal_quality,
        op4_mixing,
        op5_url_filter,
        op6_jaccard_join,
        op7_toxicity,
        op8_tiff,
        op9_html_main,
        op10_packing,
        op11_centroids,
        op12_prefix_trie,
        op13_secret_scan,
    )
}
ORACLES: dict[str, str] = {"op4_mixing": mixing.ORACLE, "op5_url_filter": url_filter.ORACLE, "op11_centroids": centroids.oracle(), "op12_prefix_trie": prefix_trie.ORACLE}
