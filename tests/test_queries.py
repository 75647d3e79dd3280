"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connect
from conftest import SF_DIR

from scriptorium.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, rows = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert problem is None
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
