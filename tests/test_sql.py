"""Every query of the core that SQL can express gives the rows of its SQL; the others run."""

import pytest
from compare import spark_rows, sql_rows

from rookery.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tables, name):
    df = catalog.queries()[name](spark, tables)
    assert len(set(df.columns)) == len(df.columns)
    got, sql = spark_rows(df), catalog.oracle_sql().get(name)
    if sql:
        assert got == sql_rows(tables, sql)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark, tables):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
