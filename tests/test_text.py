from __future__ import annotations

from datetime import datetime

import pytest

from rollcall.functions import text


def shown(spark, function, values, kind):
    rows = spark.createDataFrame([(value,) for value in values], f"v {kind}")
    return [row[0] for row in rows.select(function("v")).collect()]


def test_duration_limits(spark):
    expected = {
        0: "0 ms",
        99: "99 ms",
        100: "0.1 s",
        999: "1.0 s",
        1000: "1 s",
        12500: "13 s",
        59499: "59 s",
        59600: "60 s",
        60000: "1.0 min",
        599999: "10.0 min",
        600000: "10 min",
        3599999: "60 min",
        3600000: "1.0 h",
        None: None,
    }
    assert shown(spark, text.duration_text, expected, "bigint") == list(expected.values())


def test_verbose_duration_keeps_empty_parts(spark):
    second, minute, hour, day, week, year = (
        1000, 60000, 3600000, 86400000, 604800000, 31536000000,
    )
    expected = {
        0: "0 ms",
        35: "35 ms",
        999: "999 ms",
        second: "1 second ",
        5 * second + 35: "5 seconds 35 ms",
        minute: "1 minute ",
        minute + 2 * second + 7: "1 minute 2 seconds",
        hour: "1 hour  ",
        hour + 5 * second: "1 hour  5 seconds",
        2 * hour + 3 * minute: "2 hours 3 minutes ",
        day: "1 day  ",
        day + minute: "1 day  1 minute",
        week: "1 week  ",
        week + 6 * day + 23 * hour: "1 week 6 days 23 hours",
        # Days are those beyond whole weeks of the entire length: 365 is 52 * 7 + 1.
        year: "1 year  1 day",
        2 * year + 3 * week + day: "2 years 3 weeks 3 days",
        364 * day: "52 weeks  ",
        None: None,
    }
    assert shown(spark, text.duration_text_verbose, expected, "bigint") == list(
        expected.values()
    )


def test_magnitude_switches_at_two_units(spark):
    expected = {
        0.0: "0",
        1.9: "1",
        -5.7: "-5",
        1999.0: "1999",
        1999.9: "1999",
        2000.0: "2.0 K",
        1999999.0: "2000.0 K",
        2e6: "2.0 M",
        2.55e9: "2.6 B",
        2e12: "2.0 T",
        float("nan"): "0",
        -1e12: "-2147483648",
        None: None,
    }
    assert shown(spark, text.magnitude_text, expected, "double") == list(expected.values())


def test_memory(spark):
    expected = {
        0: "0.0 B",
        1: "1024.0 KB",
        2: "2.0 MB",
        512: "512.0 MB",
        2047: "2047.0 MB",
        2048: "2.0 GB",
        2 << 20: "2.0 TB",
        None: None,
    }
    assert shown(spark, text.memory_text, expected, "int") == list(expected.values())


def test_stamp(spark):
    stamps = [datetime(2024, 2, 3, 4, 5, 6, 999999)]
    assert shown(spark, text.stamp_text, stamps, "timestamp_ntz") == ["2024/02/03 04:05:06"]


@pytest.mark.parametrize(
    ("failed", "skipped", "label"),
    [
        (0, 0, "3/9"),
        (1, 0, "3/9 (1 failed)"),
        (0, 2, "3/9 (2 skipped)"),
        (1, 2, "3/9 (1 failed) (2 skipped)"),
    ],
)
def test_progress_label(spark, failed, skipped, label):
    frame = spark.createDataFrame([(3, 9, failed, skipped)], "c int, t int, f int, s int")
    assert frame.select(text.progress_label("c", "t", "f", "s")).first()[0] == label
