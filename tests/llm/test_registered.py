"""Registered queries against their SQL, and the pipeline's stages."""

import os

import pytest

import corpus_pipeline
from meterloom.llm.queries import ORACLES, QUERIES
from oracle_check import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    ok, why, n = compare(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLES[name])
    assert ok, why
    assert n > 0


def test_stages_take_effect_and_keep_columns(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == first.columns, name
        docs = corpus_pipeline.materialise(out, name)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    assert docs.join(first, "doc_id", "left_anti").count() == 0


def test_pipeline_packs_what_the_mix_kept(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() > 0
    assert out.where("offset < 0 or length < 1 or offset + length > 2048").count() == 0
