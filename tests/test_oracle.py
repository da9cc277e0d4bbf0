"""Every query with a SQL twin gives the same rows as the twin, on the smallest given tables."""

import pytest

from labelwright.plans import catalog
from tests.oracle_harness import compare, connect

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    problem, _n = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], PATH)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_twin(spark, name):
    assert catalog.QUERIES[name](spark, PATH).columns
