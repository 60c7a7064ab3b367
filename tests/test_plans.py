"""The plans the jobs are meant to get."""

from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from rollcall.operators import links, registry, reports
from rollcall.plans.catalog import queries
from rollcall.sources import heartbeats, registrations, table


def final_plan(frame):
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture
def small_partitions(spark):
    """No broadcast, and partitions count as skewed from a few kB on."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "12",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def skewed_events(spark):
    """A third of all events belong to one user."""
    return spark.range(0, 60_000, 1, 8).select(
        F.col("id").alias("event_id"),
        F.timestamp_micros(F.col("id") * 1000).alias("ts"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 9001).alias("user_id"),
        F.when(F.col("id") % 2 == 0, "signup").otherwise("view").alias("event_type"),
        F.lit(1.0).alias("value"),
        F.lit('{"k": 1}').alias("props"),
    )


def test_hot_id_is_split_in_the_heartbeat_join(small_partitions, skewed_events):
    reg, hb = registrations(skewed_events), heartbeats(skewed_events)
    assert "SortMergeJoin(skew=true)" in final_plan(registry.heartbeat_outcomes(reg, hb))


def test_hot_address_never_enters_the_owner_join(small_partitions, skewed_events, hot_from):
    hot_from(1000)
    result = registry.registration_outcomes(registrations(skewed_events))
    plan = final_plan(result)
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
    # Owners are aggregated once and used three times.
    assert plan.count("functions=[partial_min(struct") == 1
    counts = {row.outcome: row["count"] for row in result.groupBy("outcome").count().collect()}
    hot_from(10**9)
    plain = registry.registration_outcomes(registrations(skewed_events))
    assert result.exceptAll(plain).count() == 0 and plain.count() == sum(counts.values()) == 30_000


def test_a_hot_id_is_combined_before_the_semi_join(small_partitions, skewed_events):
    reg, hb = registrations(skewed_events), heartbeats(skewed_events)
    plan = final_plan(registry.container_state(registry.registry(reg), hb))
    before_shuffle = plan.split("LeftSemi")[1]
    assert "HashAggregate(keys=[id" in before_shuffle


def test_scans_read_only_what_is_used(spark):
    events = table(spark, SMALL, "events")
    plan = final_plan(registry.last_seen(registrations(events), heartbeats(events)))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)]" in plan
    assert "PushedFilters: [In(event_type, [click,purchase,view])]" in plan

    tags = final_plan(links.offending_tags(table(spark, SMALL, "pages")))
    assert "ReadSchema: struct<html:string>" in tags
    assert tags.count("FileScan") == 1 and tags.count("regexp_extract_all") == 1


def test_one_shuffle_of_the_rows_for_a_duration_report(spark):
    orders = table(spark, SMALL, "orders")
    plan = final_plan(reports.duration_report(orders, "o_custkey", "o_orderdate"))
    assert plan.count("Exchange hashpartitioning(o_custkey") == 1


def test_top_of_a_listing_is_not_a_full_sort(spark):
    plan = final_plan(queries()["listing_by_memory_top"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("name", sorted(set(queries()) - {"cached_query"}))
def test_no_cross_joins(spark, name):
    if name.startswith("stream_"):
        pytest.skip("runs its stream when built")
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
