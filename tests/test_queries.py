"""Every query of the library against its SQL on the smallest tables."""

import pytest

from conftest import SMALL, same_rows
from tilework import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert len(QUERIES[name](spark, SMALL).toPandas()) > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {r["split"] for r in entry.entry(spark).collect()} == {"train", "val", "test"}
