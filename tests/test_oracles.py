import pytest

from cairn.plans import registry
from oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
