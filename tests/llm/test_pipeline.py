"""Registered queries of the operators, and the pipeline stage by stage against plain versions."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from compare import connect, differences

import __spark_entry__ as contract
import corpus_pipeline
from aisle.llm import exact_dedup, ngram_join, toxicity
from aisle.llm.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="the documents are not here")


def test_every_operator_and_the_pipeline_are_registered():
    names = [name for name in contract.queries() if re.match(r"op\d+_", name)]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert set(QUERIES) == {*names, "pipeline"} and set(ORACLES) <= set(QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_their_sql(spark, name):
    assert differences(name, contract.queries()[name](spark, str(DATA)), connect(str(DATA))) == []


@needs_data
def test_stages_take_effect_one_after_another(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns, before = docs.columns, docs
    labels = spark.read.parquet(str(DATA / "labels.parquet"))
    expected = {
        "toxicity": lambda d: [r["doc_id"] for r in toxicity.classify(d, labels).collect() if not r["predicted"]],
        "exact_dedup": lambda d: [r["doc_id"] for r in exact_dedup.exact_groups(d).collect() if r["kept"]],
        "ngram_jaccard": lambda d: [r["doc_id"] for r in ngram_join.near_duplicates(d).collect() if r["doc_id"] == r["component_id"]],
        "pii": lambda d: [r["doc_id"] for r in d.collect()],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(DATA))
        assert after.columns == columns
        assert sorted(r["doc_id"] for r in after.collect()) == sorted(expected[name](before)), name
        before = after
    assert not any(re.search(r"[a-z0-9]@mail[0-9]", r["text"] or "") for r in before.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, before, str(DATA))
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in before.collect()}
