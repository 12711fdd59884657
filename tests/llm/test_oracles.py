import pytest
from oracle import assert_same, connect

from logloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[name])
