"""Every query and every stage on odd and on empty tables."""

import pytest

import corpus_pipeline
from lattica.llm import registry

from .helpers import odd_documents, sf

#: Queries that give a row per row of documents.
PER_ROW = ["op1_line_dedup", "op2_perplexity_quality", "op3_language_id", "op4_bit_planes", "op5_sentencepiece", "op7_ogg_media", "op9_secret_scan", "op10_simhash"]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_table(spark, tmp_path, name):
    docs = odd_documents(spark)
    got = registry.queries()[name](spark, sf(tmp_path, docs)).collect()
    if name in PER_ROW:
        assert len(got) == docs.count()
    if name == "op8_hierarchical_packing":
        assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_table(spark, tmp_path, name):
    assert registry.queries()[name](spark, sf(tmp_path, odd_documents(spark).limit(0))).collect() == []


@pytest.mark.parametrize("rows", ["all", "none"])
def test_stages(spark, tmp_path, rows):
    docs = odd_documents(spark)
    docs = docs if rows == "all" else docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.collect()
        if k in (1, 3):
            assert out.count() == docs.count()
