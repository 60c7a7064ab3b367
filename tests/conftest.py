from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from rollcall import build_session  # noqa: E402
from rollcall.plans.skew import DEFAULT_HOT_KEY_ROWS, HOT_KEY_ROWS  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        extra={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot_from(spark):
    """Set from how many rows on a key is treated as hot."""

    def set_rows(rows: int) -> None:
        spark.conf.set(HOT_KEY_ROWS, str(rows))

    yield set_rows
    spark.conf.set(HOT_KEY_ROWS, str(DEFAULT_HOT_KEY_ROWS))
