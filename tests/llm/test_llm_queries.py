"""Every query of the subpackage against its SQL, and against the rows its contract asks for."""

import pytest

from tests.conftest import rows_of
from textloom.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = llm.QUERIES[name](spark, sf_dir)
    want = duck.sql(llm.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name,table", [("op2_lm_scoring", "documents"), ("op3_simhash_near_dedup", "documents"), ("op4_html_extraction", "pages"), ("op6_language_id", "documents"), ("op9_source_mixing", "documents"), ("op10_token_count", "documents")])
def test_a_row_for_each_row(spark, sf_dir, name, table):
    assert llm.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
