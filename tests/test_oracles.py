import pytest

from pageflow.plans import registry
from tests.oracles import compare


def test_every_query_has_sql():
    assert set(registry.oracle_sql()) == set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sf001, name):
    compare(spark, sf001, registry.queries()[name], registry.oracle_sql()[name])


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
