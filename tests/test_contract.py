"""The driver contract: entry on sf0.001, every query has a builder, a sample of keys matches its
oracle at sf0.01 (the full sweep is ``python tests/run_oracle.py``)."""

import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare, duck

SAMPLE = ["session_titles", "render_history", "rate_limit", "deep_clean", "describe", "corr_matrix", "histogram",
          "violin_density", "knn_l2", "mmr_rerank", "page_paragraphs", "page_links", "chunk_conservation",
          "csv_roundtrip", "stream_titles", "clean_log", "pie_top6", "prompts"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"title", "chunk_id", "content", "source"}
    assert df.count() > 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 90


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, duck(sf), name, E.queries()[name], E.oracle_sql().get(name), sf)
    assert r.get("values_match", True), r
