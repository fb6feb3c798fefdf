"""Every query of the reference's operators against its DuckDB oracle at sf0.01: row count,
column names and order-insensitive values (doubles to 6 places)."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from prefscope.plans.queries import QUERIES

from conftest import SF001


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF001)
    assert ok, msg
