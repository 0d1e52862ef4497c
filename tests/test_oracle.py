"""Every core query with SQL gives what DuckDB gives."""

import pytest

from reviewlake.plans import catalog
from tests.oracle import compare, connect

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, con, name):
    compare(catalog.queries()[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
