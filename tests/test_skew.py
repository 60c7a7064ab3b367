"""Hot keys take another route to the same rows."""

from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import SMALL
from logs import log, random_rows, split
from pyspark.sql import functions as F

from rollcall.functions.clock import epoch_micros
from rollcall.operators import liveness, registry, reports
from rollcall.plans import skew
from rollcall.sources import registrations, table

KINDS = ("register", "heartbeat")
TIMEOUT = timedelta(seconds=40)

JOBS = {
    "attempts": lambda reg, hb: registry.attempt_tiers(reg),
    "gaps": lambda reg, hb: liveness.heartbeat_gaps(reg, hb, TIMEOUT),
    "spans": lambda reg, hb: liveness.alive_spans(reg, hb, TIMEOUT),
    "durations": lambda reg, hb: reports.duration_report(hb, "address", "ts"),
}


@pytest.fixture(scope="module")
def logs(spark):
    made = log(spark, random_rows(11, 1500, 25, 2, KINDS)).cache()
    yield split(made)
    made.unpersist()


@pytest.mark.parametrize("job", JOBS)
def test_hot_route_gives_the_same_rows(spark, logs, hot_from, job):
    plain = JOBS[job](*logs).collect()
    for rows in (60, 1):
        hot_from(rows)
        assert sorted(JOBS[job](*logs).collect()) == sorted(plain)


@pytest.mark.parametrize("cells", [1, 7])
def test_any_number_of_cells(spark, logs, hot_from, monkeypatch, cells):
    plain = {job: sorted(run(*logs).collect()) for job, run in JOBS.items()}
    monkeypatch.setattr(skew, "CELLS", cells)
    monkeypatch.setattr(reports, "CELLS", cells)
    hot_from(1)
    for job, run in JOBS.items():
        assert sorted(run(*logs).collect()) == plain[job], job


def test_hot_list_has_every_key_from_the_bar_on(spark, logs, hot_from):
    hot_from(40)
    _, hb = logs
    hot = skew.hot_keys(hb, "address", epoch_micros(hb, "ts"))
    sizes = hb.groupBy("address").count().where("count >= 40")
    assert 0 < hot.count() == sizes.count()
    assert {row[0] for row in hot.collect()} == {row[0] for row in sizes.collect()}


BURSTS = {
    "steady": "id * 1000",
    "nine tenths in a second": "CASE WHEN id % 10 > 0 THEN 5000000000 + id * 16 ELSE id * 1000000 END",
    "one instant": "7",
}


@pytest.mark.parametrize("burst", BURSTS)
def test_cells_have_about_equally_many_rows(spark, hot_from, burst):
    hot_from(60_000)
    rows = spark.range(60_000).selectExpr("id AS seq", f"timestamp_micros({BURSTS[burst]}) AS ts", "'a' AS id")
    _, heavy = skew.split_hot(rows, "id", epoch_micros(rows, "ts"), tie="seq")
    sizes = heavy.groupBy(skew.CELL).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "seq")).alias("lo"), F.max(F.struct("ts", "seq")).alias("hi"))
    sizes = sizes.orderBy(skew.CELL).collect()
    assert len(sizes) >= 60 and sum(row.n for row in sizes) == 60_000
    assert max(row.n for row in sizes) < 2.5 * 60_000 / 64
    assert all(before.hi < after.lo for before, after in zip(sizes, sizes[1:]))
    plain = registry.attempt_tiers(rows).collect()
    hot_from(10**9)
    assert sorted(plain) == sorted(registry.attempt_tiers(rows).collect())


def test_a_key_of_repeated_rows_and_of_null_times(spark, hot_from):
    hot_from(1)
    rows = spark.createDataFrame([("a", None, 1)] * 5 + [("a", 3, None)] * 4 + [(None, 3, 2)] * 3, "k string, s int, seq int")
    rows = rows.withColumn("ts", F.timestamp_seconds("s"))
    ordinary, heavy = skew.split_hot(rows, "k", epoch_micros(rows, "ts"), tie="seq")
    assert ordinary.count() == 0 and heavy.count() == 12
    cells = heavy.groupBy("k", "s", "seq").agg(F.countDistinct(skew.CELL).alias("n"), F.max(skew.CELL).alias("cell")).collect()
    assert {row.n for row in cells} == {1}
    at = {(row.k, row.s): row.cell for row in cells}
    assert at["a", None] < at["a", 3] and at[None, 3] == 0


def test_more_than_a_thousand_hot_keys(spark, hot_from):
    frame = spark.range(4800).selectExpr("id % 1200 AS k", "timestamp_seconds(id) AS ts")
    hot_from(2)
    assert skew.hot_keys(frame, "k", epoch_micros(frame, "ts")).count() == 1200
    found = reports.gap_statistics(frame, "k", "ts")
    assert {tuple(r)[1:] for r in found.collect()} == {(3, 1200000, 1200000, 1200000)}


def test_rows_without_a_time_have_no_gap(spark, hot_from):
    rows = [("a", None)] * 3 + [("a", 5), ("a", 9), ("a", 20)]
    frame = spark.createDataFrame(rows, "k string, s int").selectExpr("k", "timestamp_seconds(s) AS ts")
    for hot_rows in (1000, 1):
        hot_from(hot_rows)
        assert [tuple(r) for r in reports.gap_statistics(frame, "k", "ts").collect()] == [("a", 2, 4000, 7500, 11000)]


def test_null_keys_are_one_key(spark, hot_from):
    rows = [(None, 1), (None, 4), (None, 10), ("a", 2), ("a", 3)]
    frame = spark.createDataFrame(rows, "k string, s int").select(
        "k", F.timestamp_seconds("s").alias("ts")
    )
    for hot_rows in (1000, 1):
        hot_from(hot_rows)
        found = reports.gap_statistics(frame, "k", "ts").collect()
        assert {tuple(row) for row in found} == {
            (None, 2, 3000, 4500, 6000), ("a", 1, 1000, 1000, 1000)
        }


def test_ordinary_data_drops_the_hot_route(spark, logs):
    """With no hot key the final plan has one window and one shuffle of the rows."""
    reg, _ = logs
    result = registry.attempt_tiers(reg)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Window [") == 1
    assert "_is_carry" not in final


def test_hot_list_is_computed_once(spark, hot_from):
    hot_from(20)
    result = registry.attempt_tiers(registrations(table(spark, SMALL, "events")))
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("collect_list(_place") == 2  # partial and final, of one list
    assert final.count("ReusedExchange") >= 2
