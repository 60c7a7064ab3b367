"""The log operators over unbounded streams.

A run takes what is available now. Micro-batches only put their rows into a pending table, so
their cut, by files or bytes, has no bearing on the answer; at the end of the run the pending rows are
folded by the batch operators in ``(ts, seq)`` order, on top of the state that earlier runs left (an owner for
each address, the recovery state of each address, the spans of each id). No row is dropped as late: a
row older than what an earlier run answered is answered by this run, after it.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcall.functions.clock import epoch_micros, micros
from rollcall.operators.liveness import TIMEOUT
from rollcall.operators.registry import registration_outcomes
from rollcall.operators.replay import replay, replay_registry
from rollcall.sources.fleet_log import LOST, REGISTER
from rollcall.streaming.sinks import run_folded


def _earliest(rows: DataFrame) -> tuple:
    """A time and number that come before all rows when taken together."""
    ts, seq = rows.agg(F.min("ts"), F.min("seq")).first()
    return ts, seq or 0


def _placed(carry: DataFrame, rows: DataFrame, ts, seq: int, steps: int) -> DataFrame:
    """Carry messages with ``step`` 1 to ``steps``, numbered in front of the rows."""
    at = F.lit(ts).cast(rows.schema["ts"].dataType)
    number = F.lit(seq - steps - 1) + F.col("step")
    return carry.select(number.cast("long").alias("seq"), at.alias("ts"), *[n for n in carry.columns if n != "step"])


def _fold_registrations(rows: DataFrame, owners: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    ts, seq = _earliest(rows)
    every = rows
    if owners is not None:
        carry = owners.select(F.lit(1).alias("step"), "id", "address")
        every = rows.unionByName(_placed(carry, rows, ts, seq, 1))
    first = every.groupBy("address").agg(F.min_by("id", F.struct("ts", "seq")).alias("id"))
    return registration_outcomes(every).where(F.col("seq") >= seq), first


def run_registration_outcomes(sdf: DataFrame, folder: str | None = None) -> DataFrame:
    """Registration outcomes of a stream of ``seq, ts, id, address``: the table of all runs in ``folder``."""
    return run_folded(sdf.select("seq", "ts", "id", "address"), "registration-outcomes", _fold_registrations, folder)


def _as_messages(state: DataFrame) -> DataFrame:
    """Messages that bring an address into its state: ``step, kind, id, address``.

    A displaced id that is still listed has registered, was lost, and was replaced by the owner.
    """
    step = lambda n, kind, name, when: F.when(when, F.struct(F.lit(n).alias("step"), F.lit(kind).alias("kind"), F.col(name).alias("id")))
    dead, lost = F.col("dead").isNotNull(), F.col("lost")
    steps = F.array(
        step(1, REGISTER, "dead", dead), step(2, LOST, "dead", dead), step(3, REGISTER, "owner", F.lit(True)), step(4, LOST, "owner", lost)
    )
    told = state.select("address", F.explode(steps).alias("message")).where(F.col("message").isNotNull())
    return told.select("message.step", "message.kind", "message.id", "address")


def _fold_messages(rows: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    ts, seq = _earliest(rows)
    every = rows if state is None else rows.unionByName(_placed(_as_messages(state), rows, ts, seq, 4))
    listed = F.when(F.col("state") == "DEAD", F.struct("id", F.lit(True).alias("dead"), F.lit(False).alias("lost")))
    listed = listed.otherwise(F.struct("id", F.lit(False).alias("dead"), (F.col("state") == "UNKNOWN").alias("lost")))
    after = replay_registry(every).select("address", listed.alias("at")).groupBy("address").agg(
        F.max(F.when(~F.col("at.dead"), F.col("at.id"))).alias("owner"),
        F.coalesce(F.max(F.when(~F.col("at.dead"), F.col("at.lost"))), F.lit(False)).alias("lost"),
        F.max(F.when(F.col("at.dead"), F.col("at.id"))).alias("dead"),
    )
    return replay(every).where(F.col("seq") >= seq), after


def run_replay(sdf: DataFrame, folder: str | None = None) -> DataFrame:
    """Replay with losses of a stream of ``seq, ts, kind, id, address``: the table of all runs in ``folder``."""
    return run_folded(sdf.select("seq", "ts", "kind", "id", "address"), "replay", _fold_messages, folder)


def stream_last_seen(sdf: DataFrame) -> DataFrame:
    """Latest heartbeat per id over a stream of ``id, ts``; update mode."""
    return sdf.groupBy("id").agg(F.max("ts").alias("last_seen"))


def _merged(spans: DataFrame, timeout: timedelta) -> DataFrame:
    """Spans of one id that are at most ``timeout`` apart become one."""
    ordered = Window.partitionBy("id").orderBy("started_at", "last_active")
    rows = spans.withColumn("_before", F.max("last_active").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    silence = epoch_micros(rows, "started_at") - epoch_micros(rows, "_before")
    breaks = F.coalesce((silence > micros(timeout)).cast("int"), F.lit(0))
    rows = rows.withColumn("_span", F.sum(breaks).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("id", "_span").agg(
        F.min("started_at").alias("started_at"), F.max("last_active").alias("last_active"), F.sum("events").alias("events")
    ).drop("_span")


def run_alive_spans(sdf: DataFrame, timeout: timedelta = TIMEOUT, folder: str | None = None) -> DataFrame:
    """Spans of activity of a stream of ``id, ts``: all spans as of the last run in ``folder``.

    Spans are summaries that can be merged, so each run joins its heartbeats with the spans of the runs before, in
    whatever order they come; a span that is still open is there with what it has. Heartbeats of one id within one
    timeout's length of time are combined before any are ordered, so what is ordered for an id is
    at most two rows for each such length.
    """

    def fold(rows: DataFrame, spans: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        cell = F.call_function("div", epoch_micros(rows, "ts"), F.lit(max(micros(timeout), 1)))
        new = rows.groupBy("id", cell.alias("_cell")).agg(
            F.min("ts").alias("started_at"), F.max("ts").alias("last_active"), F.count(F.lit(1)).alias("events")
        ).drop("_cell")
        every = _merged(new if spans is None else new.unionByName(spans), timeout)
        out = every.select("id", "started_at", "last_active", (F.col("last_active") + F.lit(timeout)).alias("ended_at"), "events")
        return out, every

    return run_folded(sdf.select("id", "ts"), "alive-spans", fold, folder, last_only=True)
