"""Every query over nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

from collections import Counter

import pytest

import corpus_pipeline
from chronoweir.llm import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
@pytest.mark.parametrize("which", ["odd", "empty"])
def test_one_row_a_document(spark, tables, name, which):
    at, rows = tables[which]
    got = catalog.QUERIES[name](spark, at)
    assert got.columns[0] == "doc_id"
    assert Counter(r[0] for r in got.collect()) == Counter(r[0] for r in rows)


def test_empty_pipeline(spark, tables):
    assert corpus_pipeline.run(spark, tables["empty"][0]).collect() == []


def test_pipeline_over_odd_rows(spark, tables):
    at, rows = tables["odd"]
    got = corpus_pipeline.run(spark, at).collect()
    assert {r["doc_id"] for r in got} <= {r[0] for r in rows}
    assert got


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables['odd'][0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables["odd"][0]).columns == docs.columns
