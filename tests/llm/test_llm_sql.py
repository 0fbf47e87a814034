"""Every query of the subpackage runs, and gives the rows of its SQL where it has one."""

import pytest
from compare import spark_rows, sql_rows

from rookery.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, tables, name):
    got, sql = spark_rows(Q.queries()[name](spark, tables)), Q.oracle_sql().get(name)
    if sql:
        assert got == sql_rows(tables, sql)


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(Q.__file__).parents[1]
    for f in root.rglob("*.py"):
        if f.parent.name != "llm":
            assert "rookery.llm" not in f.read_text(), f
