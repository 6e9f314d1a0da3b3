"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from risewatch.plans.oracles import ORACLES
from risewatch.plans.queries import QUERIES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_entry_has_rows_and_every_query_its_sql(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, sf_dir, name):
    assert compare(spark, db, QUERIES[name], ORACLES[name], sf_dir) is None
