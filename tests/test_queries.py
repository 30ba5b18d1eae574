"""Every registered query against its SQL."""

import pytest
from compare import check, connection

from canopyframe.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    check(QUERIES[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns
