"""Every registered query of the engine against its SQL."""

import pytest
from oracle import check

from callgrain.plans.queries import ORACLE_SQL, QUERIES


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(ORACLE_SQL) <= set(e.queries())
