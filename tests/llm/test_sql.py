import pytest

from lodestar import llm

from ..compare import assert_same


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op2_warc", "op3_substring_dedup", "op10_quality_rules"])
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(llm.queries()[name](spark, sf_dir), sf_dir, llm.oracle_sql()[name])
