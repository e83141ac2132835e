"""Every registered query against its SQL counterpart on the small tables."""

import pytest

import __spark_entry__ as entry
from shotcurve.plans.queries import QUERIES
from tests.oracle_check import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    problems, rows = differences(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name])
    assert not problems
    assert rows > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
