"""The corpus pipeline: each stage against brute force on what its predecessor kept."""

import os

import pyarrow as pa
import pytest
from tests.llm.test_jaccard_join import brute

import corpus_pipeline
from tickloom.llm import common, mixing, packing, pii

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.8 * docs.count()

    unique = stages["n-gram Jaccard join"](spark, docs, SF)
    classes = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r["doc_id"] for r in unique.collect()} == {c for _, _, c in classes}

    redacted = stages["PII"](spark, docs, SF)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    assert not any(pii.base_spans(r["text"] or "") for r in redacted.collect())

    mixed = stages["mixing sources to target weights"](spark, docs, SF)
    assert sum(len((r["text"] or "").encode().split()) for r in mixed.collect()) == sum(r["taken"] for r in mixing.mix(docs).collect())

    packed = stages["best-fit packing"](spark, docs, SF).collect()
    assert len(packed) == packing.cut_pieces(docs).count()


def test_redaction_takes_one_python_worker_a_task(spark):
    texts = ["write to a.b@x.org or +49 (30) 123-4567", None, "", "nothing here", "card 4111 1111 1111 1111, ip 10.0.0.255"] * 130
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    redacted = dict(corpus_pipeline.STAGES)["PII"](spark, docs, SF)
    assert redacted._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs, ["doc_id"]).collect()}
    want = [(i, None if t is None else pii.redact(t, spans[i]), None if t is None else len(pii.redact(t, spans[i]))) for i, t in enumerate(texts)]
    assert sorted(map(tuple, redacted.select("doc_id", "text", "n_chars").collect())) == want


def test_texts_come_to_python_in_small_batches(spark, monkeypatch):
    """Each stage bounds them, unless the session has a bound of its own."""
    for module, name in ((corpus_pipeline.jaccard_join, "one_of_each"), (mixing, "mixed_rows"), (packing, "pack")):
        monkeypatch.setattr(module, name, lambda docs: docs)
    monkeypatch.setattr(pii, "redact_all", lambda docs, columns: docs)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows]})

    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('word ', 4000) AS text", "'en' AS lang", "'a' AS source", "20000L AS n_chars").coalesce(1)
    for _, stage in corpus_pipeline.STAGES[1:]:
        spark.conf.unset(common.BATCH)
        stage(spark, docs.limit(3), SF)
        rows = [r["rows"] for r in docs.mapInArrow(run, "rows long").collect()]
        assert sum(rows) == 600 and max(rows) <= 120
    spark.conf.set(common.BATCH, "64m")
    common.bound_batches(spark)
    assert spark.conf.get(common.BATCH) == "64m"
    spark.conf.unset(common.BATCH)
