"""Every query of the catalogue against its SQL."""

import pytest
from oracle import connect, difference

from lexispark.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf, name):
    assert difference(catalogue.QUERIES[name](spark, sf), con, catalogue.ORACLES[name]) is None
