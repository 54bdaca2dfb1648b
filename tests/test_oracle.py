"""Every registered query against its SQL, and the driver contract."""

import pytest
from oracle_compare import connect, differences

import __spark_entry__ as entry_file
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLE[name]) == []


def test_every_query_is_accounted_for():
    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(entry_file.queries()) and set(ORACLE) <= set(entry_file.oracle_sql())


def test_entry_has_rows(spark):
    assert entry_file.entry(spark).count() == 8
