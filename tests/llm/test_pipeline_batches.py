"""Stages of the pipeline hand rows to workers in batches that are bounded by bytes."""

from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depotwise.llm import near_dedup


def largest_batch(spark):
    def measure(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["n"])

    wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("text"))
    return wide.mapInArrow(measure, "n bigint").agg(F.max("n")).first()[0]


@pytest.fixture
def unset(spark):
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING, None)
    spark.conf.unset(corpus_pipeline.BATCH_SETTING)
    yield
    spark.conf.unset(corpus_pipeline.BATCH_SETTING) if before is None else spark.conf.set(corpus_pipeline.BATCH_SETTING, before)


def test_batches_of_stages_are_bounded_while_and_after_they_run(spark, unset, monkeypatch):
    assert largest_batch(spark) > 3 * corpus_pipeline.BATCH_BYTES
    during = []

    def spy(df, name, write=near_dedup.materialise):
        during.append(spark.conf.get(corpus_pipeline.BATCH_SETTING, None))
        return write(df, name)

    monkeypatch.setattr(near_dedup, "materialise", spy)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([text, text + " more", "other words"])],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert set(during) == {str(corpus_pipeline.BATCH_BYTES)}
    assert largest_batch(spark) < 1.1 * corpus_pipeline.BATCH_BYTES


def test_a_bound_of_the_session_stays(spark, unset):
    spark.conf.set(corpus_pipeline.BATCH_SETTING, "1000000")
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == "1000000"
