"""The registered queries: every operator applied to the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators import cache, export, links, liveness, registry, replay, reports, timeline
from rollcall.sources import (
    heartbeats,
    losses,
    message_log,
    new_folder,
    registrations,
    table,
    table_stream,
)
from rollcall.sources.document import read_document
from rollcall.sources.fleet_log import REGISTER
from rollcall.streaming import (
    run_alive_spans,
    run_answers,
    run_closed_spans,
    run_registration_outcomes,
    run_replay,
    run_updates,
    stream_last_seen,
)

Query = Callable[[SparkSession, str], DataFrame]

DAY = timedelta(hours=24)
MASTER_URL = "fleet://host-0:7077"
MASTER_WEB_UI_URL = "http://host-0:8080"
TOP = 20
ORDER_STAGES = {"F": reports.COMPLETED, "O": reports.STARTED, "P": reports.SKIPPED}
PAGE_TAGS = (
    "a", "span", "article", "b", "body", "br", "div", "footer", "h1", "head", "html", "li",
    "meta", "nav", "p", "script", "style", "title", "ul",
)


def _on_log(job: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """A query over the registration and heartbeat logs."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        events = table(spark, folder, "events")
        return job(registrations(events), heartbeats(events))

    return run


def _on_registry(job: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_log(lambda reg, hb: job(registry.registry(reg)))


def _on(name: str, job: Callable[[DataFrame], DataFrame]) -> Query:
    """A query over one table."""
    return lambda spark, folder: job(table(spark, folder, name))


def _plain_times(rows: DataFrame) -> DataFrame:
    """Stamps as the tables have them, without a zone."""
    return rows.withColumns({name: F.col(name).cast("timestamp_ntz") for name, kind in rows.dtypes if kind == "timestamp"})


def _on_stream(job: Callable[[DataFrame], DataFrame]) -> Query:
    """A query over the events as a stream, run to completion."""
    return lambda spark, folder: job(table_stream(spark, folder, "events"))


def _lost_containers(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return registry.container_state(
        registry.registry(registrations(events)), losses(events), MASTER_URL, MASTER_WEB_UI_URL
    )


def _liveness(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    latest = events.agg(F.max("ts").alias("latest")).scalar()
    return liveness.liveness(registrations(events), heartbeats(events), latest, DAY)


def _fleet_document(spark: SparkSession, folder: str) -> DataFrame:
    """The fleet document, written as one file of parts and read back by offset."""
    fleet = registry.registry(registrations(table(spark, folder, "events")))
    target = new_folder(spark, "fleet-document")
    export.write_fleet_document(fleet, target, MASTER_URL)
    return read_document(spark, target)


def _fleet_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    """The fleet at the start of every hour in which something happened."""
    events = table(spark, folder, "events")
    hours = events.select(F.date_trunc("hour", "ts").cast(events.schema["ts"].dataType).alias("as_of"))
    return timeline.fleet_at(registrations(events), heartbeats(events), hours, DAY)


def _state_at_losses(spark: SparkSession, folder: str) -> DataFrame:
    """What was known of a container when it was reported lost."""
    events = table(spark, folder, "events")
    asked = losses(events).select("id", F.col("ts").alias("as_of"))
    return timeline.state_at(registrations(events), heartbeats(events), asked, DAY)


def _joined_tags(audit: DataFrame) -> DataFrame:
    return audit.withColumn("offending_tags", F.array_join("offending_tags", ","))


PINNED_COLUMNS = ["l_returnflag", "l_quantity"]
LAYOUT = 8


def _quantity_by_flag(lineitem: DataFrame) -> DataFrame:
    return (
        lineitem.filter(F.col("l_quantity") > 30)
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))
    )


def _quantity_in_all(lineitem: DataFrame) -> DataFrame:
    every = (F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))
    return lineitem.agg(*every).select(F.lit("all").alias("l_returnflag"), "rows", "quantity")


def _on_one_pin(lineitem: DataFrame) -> DataFrame:
    return cache.on_pinned(lineitem, PINNED_COLUMNS, [_quantity_by_flag, _quantity_in_all])


def _after_release(lineitem: DataFrame) -> DataFrame:
    """A pin is filled and released; what is read through it then comes from its source."""
    pinned = cache.cached(lineitem, PINNED_COLUMNS)
    other = cache.cached(lineitem, PINNED_COLUMNS)
    try:
        pinned.count()
        released = cache.release(pinned)
        held = (released.storageLevel.useMemory, other.storageLevel.useMemory)
    finally:
        cache.release(other)
    return _quantity_by_flag(released).withColumns(
        {"pinned": F.lit(held[0]), "other_pinned": F.lit(held[1])}
    )


def _footprint(lineitem: DataFrame) -> DataFrame:
    """Of a layout that is fixed by the order key."""
    laid = lineitem.repartitionById(LAYOUT, (F.col("l_orderkey") % LAYOUT).cast("int"))
    return cache.on_pinned(laid, ["l_orderkey"], [cache.partition_footprint])


def queries() -> dict[str, Query]:
    return {
        "registration_outcomes": _on_log(lambda reg, hb: registry.registration_outcomes(reg)),
        "accepted_registry": _on_registry(lambda fleet: fleet),
        "heartbeat_outcomes": _on_log(registry.heartbeat_outcomes),
        "last_seen": _on_log(registry.last_seen),
        "fleet_snapshot": _on_registry(registry.fleet_snapshot),
        "fleet_snapshot_by_memory_free": _on_registry(
            lambda fleet: registry.fleet_snapshot(fleet, by="memory_free")
        ),
        "fleet_snapshot_text": _on_registry(
            lambda fleet: registry.readable_totals(registry.fleet_snapshot(fleet))
        ),
        "fleet_listing": _on_registry(registry.fleet_listing),
        "listing_by_memory": _on_registry(registry.listing_by_memory),
        "listing_by_memory_top": _on_registry(
            lambda fleet: registry.listing_by_memory(fleet, TOP)
        ),
        "container_state": _lost_containers,
        "container_state_json": lambda spark, folder: export.container_state_json(
            _lost_containers(spark, folder)
        ),
        "container_json": _on_registry(export.container_json),
        "fleet_json": _on_registry(lambda fleet: export.fleet_json(fleet, MASTER_URL)),
        "fleet_document": _fleet_document,
        "attempt_tiers": _on_log(lambda reg, hb: registry.attempt_tiers(reg)),
        "replay": _on("events", lambda events: replay.replay(message_log(events))),
        "replay_registry": _on(
            "events", lambda events: replay.replay_registry(message_log(events))
        ),
        "replay_fleet_snapshot": _on(
            "events",
            lambda events: registry.fleet_snapshot(
                replay.replay_registry(message_log(events, with_request=True))
            ),
        ),
        "liveness": _liveness,
        "heartbeat_gaps": _on_log(lambda reg, hb: liveness.heartbeat_gaps(reg, hb, DAY)),
        "alive_spans": _on_log(lambda reg, hb: liveness.alive_spans(reg, hb, DAY)),
        "fleet_by_hour": _fleet_by_hour,
        "state_at_losses": _state_at_losses,
        "stream_registration_outcomes": _on_stream(
            lambda events: run_registration_outcomes(registrations(events))
        ),
        "stream_last_seen": _on_stream(
            lambda events: run_updates(
                stream_last_seen(heartbeats(events)), "id", "last_seen", "last-seen"
            )
        ),
        "stream_alive_spans": _on_stream(
            lambda events: run_alive_spans(heartbeats(events), DAY)
        ),
        "stream_replay": _on_stream(
            lambda events: run_replay(message_log(events))
        ),
        "stream_answers": _on_stream(lambda events: _plain_times(run_answers(message_log(events)))),
        "stream_registration_answers": _on_stream(
            lambda events: _plain_times(run_answers(registrations(events).withColumn("kind", F.lit(REGISTER)))).drop("kind")
        ),
        "stream_closed_spans": _on_stream(lambda events: _plain_times(run_closed_spans(heartbeats(events), DAY))),
        "duration_report_events": _on(
            "events", lambda events: reports.duration_report(events, "user_id", "ts")
        ),
        "duration_report_orders": _on(
            "orders", lambda orders: reports.duration_report(orders, "o_custkey", "o_orderdate")
        ),
        "duration_report_verbose_events": _on(
            "events", lambda events: reports.duration_report_verbose(events, "user_id", "ts")
        ),
        "duration_report_verbose_orders": _on(
            "orders",
            lambda orders: reports.duration_report_verbose(orders, "o_custkey", "o_orderdate"),
        ),
        "magnitude_report_lineitem": _on(
            "lineitem",
            lambda lines: reports.magnitude_report(lines, ["l_returnflag"], "l_extendedprice"),
        ),
        "magnitude_report_suppliers": _on(
            "lineitem",
            lambda lines: reports.magnitude_report(
                lines, ["l_suppkey", "l_linestatus"], "l_quantity"
            ),
        ),
        "magnitude_report_orders": _on(
            "orders",
            lambda orders: reports.magnitude_report(orders, ["o_orderpriority"], "o_totalprice"),
        ),
        "stamp_report_events": _on(
            "events", lambda events: reports.stamp_report(events, "user_id", "ts")
        ),
        "stamp_report_orders": _on(
            "orders", lambda orders: reports.stamp_report(orders, "o_custkey", "o_orderdate")
        ),
        "progress_report": _on(
            "orders",
            lambda orders: reports.progress_report(
                orders, ["o_orderpriority"], "o_orderstatus", ORDER_STAGES
            ),
        ),
        "markup_audit": _on("pages", lambda pages: _joined_tags(links.markup_audit(pages))),
        "markup_audit_page_tags": _on(
            "pages", lambda pages: _joined_tags(links.markup_audit(pages, PAGE_TAGS))
        ),
        "shown_markup": _on("pages", lambda pages: links.shown_markup(pages, "/proxy", PAGE_TAGS)),
        "markup_summary": _on("pages", links.markup_summary),
        "offending_tags": _on("pages", links.offending_tags),
        "resolve_links": _on("pages", links.resolve_links),
        "link_in_degree": _on("pages", links.link_in_degree),
        "cached_query": _on("lineitem", _on_one_pin),
        "released_query": _on("lineitem", _after_release),
        "partition_footprint": _on("lineitem", _footprint),
    }
