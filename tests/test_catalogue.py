"""Every catalogued query with checking SQL, on the smallest tables."""

import pytest
from oracle import both, connection

from veilspan.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, con, name):
    ours, theirs = both(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
    assert ours == theirs


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
