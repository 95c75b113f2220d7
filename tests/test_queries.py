"""Every registered query of the core against its SQL."""

import pytest

from tests.conftest import rows_of
from textloom.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = core.QUERIES[name](spark, sf_dir)
    want = duck.sql(core.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(core.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_queries_of_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings", "events", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("spread_sample", "model_stand_in", "corpus_composition", "group_split", "window_hash_dedup", "page_cap", "source_sms_ham", "encode_windows"):
        core.QUERIES[name](spark, str(tmp_path)).collect()
