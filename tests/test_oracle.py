"""Every registered query against its SQL statement, and the driver contract."""

import pytest

import __spark_entry__ as contract
from compare import check, connect
from shiftledger.plans.catalog import QUERIES
from shiftledger.plans.oracle import statements

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(SF)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(statements()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    assert check(spark, oracle, SF, name) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["operador", "total", "realizados", "eficiencia"] and df.count() > 0
