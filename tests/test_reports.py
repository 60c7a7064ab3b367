from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from rollcall.operators import reports


@pytest.mark.parametrize("hot_rows", [1_000_000, 30, 1])
def test_gap_statistics_against_python(spark, hot_from, hot_rows):
    hot_from(hot_rows)
    chance = random.Random(3)
    stamps = {
        key: sorted(chance.randrange(10 ** chance.choice([3, 6, 9])) for _ in range(size))
        for key, size in {"one": 1, "two": 2, "even": 41, "odd": 52, "same": 1}.items()
    }
    stamps["same"] = [7] * 9
    rows = [(key, stamp) for key, of_key in stamps.items() for stamp in of_key]
    chance.shuffle(rows)
    frame = spark.createDataFrame(rows, "key string, ms bigint").select(
        "key", F.timestamp_millis("ms").alias("ts")
    )
    expected = {}
    for key, of_key in stamps.items():
        gaps = [later - earlier for earlier, later in zip(of_key, of_key[1:])]
        expected[key] = (
            (len(gaps), min(gaps), int(statistics.median(gaps)), max(gaps))
            if gaps
            else (0, None, None, None)
        )
    found = reports.gap_statistics(frame, "key", "ts").collect()
    assert {row[0]: tuple(row)[1:] for row in found} == expected


def test_report_texts(spark):
    frame = spark.createDataFrame([("a", 0), ("a", 5), ("a", 3665), ("b", 1)], "k string, s int")
    frame = frame.select("k", F.timestamp_seconds("s").alias("ts"))
    texts = ["min_text", "median_text", "max_text"]
    short = reports.duration_report(frame, "k", "ts").orderBy("k").select(*texts).collect()
    assert [tuple(row) for row in short] == [("5 s", "31 min", "1.0 h"), (None, None, None)]
    verbose = reports.duration_report_verbose(frame, "k", "ts").orderBy("k").select(*texts)
    assert tuple(verbose.first()) == ("5 seconds ", "30 minutes 32 seconds", "1 hour 1 minute ")
    stamp = reports.stamp_report(frame, "k", "ts").filter("k = 'a'").first()
    assert tuple(stamp) == ("a", "1970/01/01 00:00:00", "1970/01/01 01:01:05")


def test_magnitudes(spark):
    frame = spark.range(2000).select(F.lit("k").alias("k"), F.lit(1000.5).alias("v"))
    row = reports.magnitude_report(frame, ["k"], "v").first()
    assert tuple(row) == ("k", 2000, 2001000.0, "2.0 K", "2.0 M")


def test_progress_counts_every_row(spark):
    statuses = ["F"] * 3 + ["O"] * 2 + ["X"] + ["P"] * 2 + ["?"] * 2
    frame = spark.createDataFrame([("g", status) for status in statuses], "g string, s string")
    mapping = {"F": "completed", "O": "started", "X": "failed", "P": "skipped"}
    row = reports.progress_report(frame, ["g"], "s", mapping).first().asDict()
    assert row == {
        "g": "g", "total": 10, "completed": 3, "started": 2, "failed": 1, "skipped": 2,
        "completed_percent": 30.0, "started_percent": 20.0,
        "label": "3/10 (1 failed) (2 skipped)",
    }
    none = reports.progress_report(frame, ["g"], "s", {"F": "completed"}).first()
    assert (none.failed, none.label) == (0, "3/10")


def test_unit_follows_from_the_sum_itself(spark):
    frame = spark.createDataFrame([("a", 1999.996), ("b", 2000.0)], "k string, v double")
    found = {r.k: (r.total, r.total_text) for r in reports.magnitude_report(frame, ["k"], "v").collect()}
    assert found == {"a": (2000.0, "1999"), "b": (2000.0, "2.0 K")}
