"""Queries with a SQL form against DuckDB."""

from __future__ import annotations

import pytest
from comparing import connect, differences
from conftest import MEDIUM

from rollcall.llm.oracle import oracle_sql
from rollcall.llm.queries import queries


@pytest.fixture(scope="module")
def duck():
    connection = connect(MEDIUM)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    found = queries()[name](spark, MEDIUM).toPandas()
    expected = duck.sql(oracle_sql()[name]).df()
    assert differences(found, expected) is None
