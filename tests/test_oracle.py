"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as contract
from balsam.plans.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    difference, _rows, _has = compare(spark, con, name, SF_DIR)
    assert difference in (None, "0 rows"), difference
