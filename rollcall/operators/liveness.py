"""Liveness, heartbeat gaps and spans of activity.

The timeout check these rest on is only declared by the protocol, never carried out,
so the rules here are this library's own: silence of exactly the timeout still counts
as alive, anything longer does not.

Activity of an accepted id is its acceptance and every later heartbeat.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcall.functions.clock import epoch_micros, micros
from rollcall.operators.registry import accepted_ids, last_seen
from rollcall.plans.skew import CELL, hot_keys, previous_value, split_hot

# Default timeout, and heartbeats sent per timeout.
TIMEOUT = timedelta(seconds=60)
BEATS_PER_TIMEOUT = 4

_ORDER = ["ts", "seq"]


def liveness(
    reg: DataFrame, hb: DataFrame, as_of: Column, timeout: timedelta = TIMEOUT
) -> DataFrame:
    """ALIVE if seen within ``timeout`` of ``as_of``, else DEAD, per accepted id.

    ``as_of`` is any single-valued column of the log's time type: a literal or a
    scalar subquery.
    """
    seen = last_seen(reg, hb).withColumn("as_of", as_of)
    silence = epoch_micros(seen, "as_of") - epoch_micros(seen, "last_seen")
    state = F.when(silence <= micros(timeout), "ALIVE").otherwise("DEAD")
    return seen.select("id", "last_seen", state.alias("state"))


def activity(reg: DataFrame, hb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, ts, seq, beat`` of accepted ids, as (ordinary, hot) parts.

    Hot ids are looked for in the raw heartbeats, before anything is shuffled by id.
    Ordinary ids need no join: acceptance is one more row of the log, and a heartbeat
    counts if that row is before it. For hot ids, of which there are a bounded number
    and whose acceptance is one row each, acceptance is broadcast.
    """
    accepted = accepted_ids(reg).select(
        "id",
        F.col("accepted_at").alias("ts"),
        F.col("accepted_seq").alias("seq"),
        F.lit(False).alias("beat"),
    )
    beats = hb.select("id", "ts", "seq", F.lit(True).alias("beat"))
    hot = hot_keys(beats, "id", epoch_micros(beats, "ts"), "seq")
    ordinary_beats, hot_beats = split_hot(beats, "id", epoch_micros(beats, "ts"), hot, "seq")
    ordinary_start, hot_start = split_hot(accepted, "id", epoch_micros(accepted, "ts"), hot, "seq")

    so_far = (
        Window.partitionBy("id")
        .orderBy(*_ORDER)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ordinary = (
        ordinary_start.unionByName(ordinary_beats)
        .withColumn("is_accepted", F.max(~F.col("beat")).over(so_far))
        .filter("is_accepted")
        .drop("is_accepted")
    )

    # One row per hot id whatever the log holds, so the broadcast stays bounded.
    start = (
        hot_start.groupBy(F.col("id").alias("hot_id"))
        .agg(F.min(F.struct("ts", "seq")).alias("hot_from"))
    )
    heavy = (
        hot_beats.join(F.broadcast(start), F.col("id") == F.col("hot_id"))
        .filter(F.struct("ts", "seq") > F.col("hot_from"))
        .drop("hot_id", "hot_from")
        .unionByName(hot_start)
    )
    return ordinary, heavy


def heartbeat_gaps(reg: DataFrame, hb: DataFrame, timeout: timedelta = TIMEOUT) -> DataFrame:
    """Silence before each updating heartbeat and the heartbeats missed in it.

    The first heartbeat is measured from acceptance, which sets the last heartbeat.
    A heartbeat is due every quarter of the timeout, so a gap of n to n+1 quarters
    missed n-1, at least 0.
    """
    ordinary, heavy = previous_value(*activity(reg, hb), "id", _ORDER, "ts", "previous")
    columns = ["id", "ts", "seq", "beat", "previous"]
    gaps = ordinary.select(*columns).unionByName(heavy.select(*columns)).filter("beat")
    silence = epoch_micros(gaps, "ts") - epoch_micros(gaps, "previous")
    due_every = micros(timeout) // BEATS_PER_TIMEOUT
    return gaps.select(
        "seq",
        "ts",
        "id",
        F.call_function("div", silence, F.lit(1000)).alias("gap_ms"),
        F.greatest(
            F.call_function("div", silence, F.lit(due_every)) - 1, F.lit(0)
        ).cast("bigint").alias("missed"),
    )


def _numbered_spans(rows: DataFrame, keys: list[str], timeout: timedelta) -> DataFrame:
    """Add ``span``: a number that goes up after each silence longer than ``timeout``."""
    in_order = Window.partitionBy(*keys).orderBy("ts")
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_before", F.lag("ts").over(in_order))
    silence = epoch_micros(rows, "ts") - epoch_micros(rows, "_before")
    breaks = F.coalesce((silence > micros(timeout)).cast("int"), F.lit(0))
    return rows.withColumn("span", F.sum(breaks).over(running))


def _span_totals(events: Column) -> list[Column]:
    return [
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_active"),
        events.alias("events"),
    ]


def _hot_spans(heavy: DataFrame, timeout: timedelta) -> DataFrame:
    """Spans of hot ids: per cell first, then across cell borders.

    Rows of one instant are counted before anything is ordered. Only the first and last span of a cell can go on in a neighbour, so what is
    merged in one place per id is at most two rows per cell.
    """
    keys = ["id", CELL]
    instants = heavy.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_rows"))
    pieces = (
        _numbered_spans(instants, keys, timeout)
        .groupBy(*keys, "span")
        .agg(*_span_totals(F.sum("_rows")))
    )
    whole_cell = Window.partitionBy(*keys)
    pieces = pieces.withColumn("_last", F.max("span").over(whole_cell)).withColumn(
        "_at_border", (F.col("span") == 0) | (F.col("span") == F.col("_last"))
    )
    in_order = Window.partitionBy("id").orderBy(CELL, "span")
    borders = pieces.filter("_at_border").withColumn(
        "_before", F.lag("last_active").over(in_order)
    )
    silence = epoch_micros(borders, "started_at") - epoch_micros(borders, "_before")
    breaks = F.coalesce((silence > micros(timeout)).cast("int"), F.lit(0))
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = (
        borders.withColumn("_joined", F.sum(breaks).over(running))
        .groupBy("id", "_joined")
        .agg(
            F.min("started_at").alias("started_at"),
            F.max("last_active").alias("last_active"),
            F.sum("events").alias("events"),
        )
    )
    columns = ["id", "started_at", "last_active", "events"]
    return pieces.filter("not _at_border").select(*columns).unionByName(merged.select(*columns))


def alive_spans(reg: DataFrame, hb: DataFrame, timeout: timedelta = TIMEOUT) -> DataFrame:
    """Unbroken runs of activity per accepted id, broken by a silence over ``timeout``.

    A span ends ``timeout`` after its last activity.
    """
    ordinary, heavy = activity(reg, hb)
    columns = ["id", "started_at", "last_active", "events"]
    spans = (
        _numbered_spans(ordinary, ["id"], timeout)
        .groupBy("id", "span")
        .agg(*_span_totals(F.count(F.lit(1))))
        .select(*columns)
        .unionByName(_hot_spans(heavy, timeout).select(*columns))
    )
    return spans.select(
        "id",
        "started_at",
        "last_active",
        (F.col("last_active") + F.lit(timeout)).alias("ended_at"),
        "events",
    )
