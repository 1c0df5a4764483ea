import pytest
from compare import rows_of, sql_rows

from veilframe import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = rows_of(queries.QUERIES[name](spark, SF))
    if name in queries.ORACLE_SQL:
        assert got == sql_rows(queries.ORACLE_SQL[name], SF)
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
