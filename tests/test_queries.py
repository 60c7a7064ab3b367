"""Every registered query against DuckDB, and the totals of a one-by-one replay."""

from __future__ import annotations

import importlib

import pytest
from comparing import connect, differences
from conftest import MEDIUM, SMALL

from rollcall.plans import catalog, oracle

contract = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def duck():
    connection = connect(SMALL)
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracle.oracle_sql())


def test_flagship(spark):
    row = contract.entry(spark).first()
    assert (row.alive, row.memory, row.memory_used) == (8, 10240, 702)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_oracle(spark, duck, name):
    found = contract.queries()[name](spark, SMALL).toPandas()
    expected = duck.sql(contract.oracle_sql()[name]).df()
    assert differences(found, expected) is None


# Totals counted by replaying the whole log one message at a time, at sf0.01.
TOTALS = {
    ("registration_outcomes", "outcome"): {
        "REGISTERED": 75, "DUPLICATE_ID": 948, "DUPLICATE_ADDRESS": 994,
    },
    ("heartbeat_outcomes", "outcome"): {"UPDATED": 2803, "IGNORED": 3166},
    ("attempt_tiers", "tier"): {
        "FIRST": 150, "INITIAL": 897, "PROLONGED": 924, "GAVE_UP": 46,
    },
    ("liveness", "state"): {"ALIVE": 55, "DEAD": 20},
    ("replay", "outcome"): {
        "REGISTERED": 550, "DUPLICATE_ID": 970, "DUPLICATE_ADDRESS": 497,
        "UPDATED": 2847, "RECONNECT": 1280, "IGNORED": 1842,
    },
    ("replay_registry", "state"): {"ALIVE": 41, "UNKNOWN": 34, "DEAD": 39},
}


@pytest.mark.parametrize(("name", "column"), list(TOTALS))
def test_totals(spark, name, column):
    counts = contract.queries()[name](spark, MEDIUM).groupBy(column).count().collect()
    expected = TOTALS[name, column]
    assert {row[0]: row[1] for row in counts if row[0] in expected} == expected
