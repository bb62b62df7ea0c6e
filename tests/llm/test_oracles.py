import pytest

from pageflow.llm import registry
from tests.oracles import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf001, name):
    compare(spark, sf001, registry.queries()[name], registry.oracle_sql()[name])
