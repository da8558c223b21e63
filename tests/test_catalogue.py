"""Every registered query against its SQL."""

import oracle
import pytest

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert oracle.compare(con, df, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["t", "party", "y", "share"]
    assert df.count() > 0
