from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rollcall.functions.clock import epoch_micros

# Around a daylight-saving change of the zone below, and before 1970.
STAMPS = [
    datetime(2024, 3, 10, 1, 59, 59, 999999),
    datetime(2024, 3, 10, 2, 30),
    datetime(2024, 3, 10, 3, 0, 0, 1),
    datetime(1969, 12, 31, 23, 59, 59, 5),
    datetime(1970, 1, 1),
]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_zoneless_stamps_are_exact_in_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(stamp,) for stamp in STAMPS], "ts timestamp_ntz")
        found = [row[0] for row in frame.select(epoch_micros(frame, "ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    epoch = datetime(1970, 1, 1)
    assert found == [(stamp - epoch) // (datetime.resolution) for stamp in STAMPS]


def test_instants_are_exact(spark):
    frame = spark.range(1).select(F.timestamp_micros(F.lit(-5)).alias("ts"))
    assert frame.select(epoch_micros(frame, "ts")).first()[0] == -5
