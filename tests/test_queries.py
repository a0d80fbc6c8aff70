"""Every registered query of the listing engine against its SQL, or at least with rows."""

import pytest
from oracle import compare, connect

from parcelyn.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    if name in catalogue.ORACLE_SQL:
        assert compare(df, con, catalogue.ORACLE_SQL[name]) is None
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
