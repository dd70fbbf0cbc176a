"""The pipeline's stages: schemas, effects, and hard cases in every stage."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import clashing, hard_docs, no_docs
from lodegraph.llm import bpe, dartminhash, langid, mixing, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "secret_redaction", "mixture", "encoding"]
    one = stages["language_id"](spark, docs, SF)
    model = langid.fit(docs.where(~langid.held_out()))
    ids = {r.doc_id for r in langid.identify(docs, model).where("not rejected").collect()}
    assert {r.doc_id for r in one.collect()} == ids and one.schema == docs.schema
    two = stages["near_dedup"](spark, one, SF)
    classes = {r.class_id for r in dartminhash.near_duplicates(one).collect()}
    assert {r.doc_id for r in two.collect()} == classes and two.schema == docs.schema
    three = stages["secret_redaction"](spark, two, SF)
    assert three.count() == two.count() and three.schema == docs.schema
    assert secret_scan.scan_secrets(three).where("size(spans) > 0").count() == 0
    assert three.where("n_chars != length(text)").count() == two.where("n_chars != length(text)").count()
    four = stages["mixture"](spark, three, SF)
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in mixing.mix(three).where("sampled").collect()} and four.schema == docs.schema
    five = stages["encoding"](spark, four, SF)
    decoded = bpe.decode_documents(five).join(four.select("doc_id", "text"), "doc_id")
    assert five.count() == four.count() and decoded.where(F.col("data") != F.encode("text", "utf-8")).count() == 0
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()} == {tuple(r) for r in five.select("doc_id", "n_tokens").collect()}


def test_mixture_learns_topics_on_every_document(spark, monkeypatch):
    """The weights of the model that the stage uses are those of the document frequencies in the whole table."""
    texts = [f"common w{i % 700} w{i % 11}x w{i}y" for i in range(5000)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    models, measured = [], mixing.measured
    monkeypatch.setattr(mixing, "measured", lambda rows, tokens, topic, model=None: models.append(model) or measured(rows, tokens, topic, model))
    assert 0 < corpus_pipeline.mixture(spark, docs, SF).count() < 5000
    counts, _ = mixing.hashed(texts)
    assert models[0].weight == pytest.approx(np.log(5001 / (1 + (counts > 0).sum(0))) + 0.01, rel=1e-5)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_hard_cases(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (hard_docs(spark), clashing(hard_docs(spark)), no_docs(spark)):
        out = stage(spark, docs, SF)
        assert name == "encoding" or out.columns == docs.columns
        assert out.count() <= docs.count()
