"""Every query of the catalogue against its SQL twin on the smallest tables."""

import pytest

from isopycna import catalogue

from .compare import duck, same

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, connection, name):
    assert name in catalogue.ORACLES
    same(catalogue.QUERIES[name](spark, DIR), connection, catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries())
