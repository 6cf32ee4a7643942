"""Every registered query against its SQL on a second engine."""

import pytest

from mapaudit.plans.oracle import ORACLE
from mapaudit.plans.registry import QUERIES
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_names():
    assert ORACLE
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, sf, name):
    assert compare(spark, con, name, sf) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql()) <= set(e.queries())
