"""The fleet as of many times at once, and single containers as of times of their own.

Both are this library's own, like the timeout they rest on. Neither pairs containers with times:
starts, ends and questions are rows of one ordered log, and an answer is a running aggregate
over it. A log too long for one task is cut into cells (:mod:`rollcall.plans.skew`).
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.clock import epoch_micros, micros
from rollcall.operators.liveness import TIMEOUT, alive_spans
from rollcall.operators.registry import accepted_ids, registry
from rollcall.plans.skew import running, split_hot

_LAST = 2**63 - 1


def fleet_at(reg: DataFrame, hb: DataFrame, times: DataFrame, timeout: timedelta = TIMEOUT) -> DataFrame:
    """``as_of, alive, memory, listed`` for each distinct time in the column ``as_of`` of ``times``.

    A container is alive from the start of a span of activity to its end, both included;
    memory is that of the alive ones, listed counts all accepted so far. Times before the first
    acceptance have zeros; null times have no row. ``as_of`` has the log's time type.

    A sweep: a span adds its container where it starts and takes it away a microsecond after
    its end. Changes of one instant combine before the shuffle, so what is
    ordered is one row for each instant with a change or a question.
    """
    fleet = registry(reg).select("id", F.col("memory").cast("bigint").alias("memory"), "accepted_at")
    spans = alive_spans(reg, hb, timeout).join(fleet.select("id", "memory"), "id")
    nothing, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def change(at: Column, alive: Column, memory: Column, listed: Column) -> Column:
        return F.struct(at.alias("as_of"), alive.alias("_alive"), memory.alias("_memory"), listed.alias("_listed"))

    ended = F.col("ended_at") + F.lit(timedelta(microseconds=1))
    steps = spans.select(
        F.explode(
            F.array(
                change(F.col("started_at"), one, F.col("memory"), nothing),
                change(ended, -one, -F.col("memory"), nothing),
            )
        ).alias("step")
    )
    listed = fleet.select(change(F.col("accepted_at"), nothing, nothing, one).alias("step"))
    asked = times.filter(F.col("as_of").isNotNull()).select(change(F.col("as_of"), nothing, nothing, nothing).alias("step"))
    rows = (
        steps.unionByName(listed)
        .select("step.*", F.lit(False).alias("_asked"))
        .unionByName(asked.select("step.*", F.lit(True).alias("_asked")))
        .groupBy("as_of")
        .agg(
            *[F.sum(name).alias(name) for name in ("_alive", "_memory", "_listed")],
            F.max("_asked").alias("_asked"),
            # One key for all rows; a literal would be folded out of the join with the hot keys, leaving a nested loop.
            F.max(F.lit(0)).alias("_all"),
        )
    )
    totals = {name: (F.sum, f"_{name}") for name in ("alive", "memory", "listed")}
    ordinary, heavy = running(*split_hot(rows, "_all", epoch_micros(rows, "as_of")), "_all", ["as_of"], totals)
    columns = ["as_of", *totals, "_asked"]
    return ordinary.select(*columns).unionByName(heavy.select(*columns)).filter("_asked").drop("_asked")


def state_at(reg: DataFrame, hb: DataFrame, asked: DataFrame, timeout: timedelta = TIMEOUT) -> DataFrame:
    """``id, as_of, last_seen, state`` for each row ``id, as_of`` of ``asked``.

    What was last seen of the container up to and with its time: its acceptance or a later
    heartbeat. ALIVE if that is no longer than ``timeout`` ago, else DEAD; both null if the id was not
    accepted by then or the row has a null. Repeated rows are answered each; other columns are not read.

    A join as of a time without a join: a heartbeat before the acceptance is never later than
    it, so the greatest time so far is the answer as soon as an acceptance is among the rows so far.
    """
    accepted = accepted_ids(reg).select("id", F.col("accepted_at").alias("ts"), F.col("accepted_seq").alias("seq"))
    rows = (
        accepted.select("id", "ts", "seq", F.lit(True).alias("_accepts"), F.lit(False).alias("_asked"))
        .unionByName(hb.select("id", "ts", "seq", F.lit(False).alias("_accepts"), F.lit(False).alias("_asked")))
        .unionByName(
            asked.select("id", F.col("as_of").alias("ts"), F.lit(_LAST).alias("seq"), F.lit(False).alias("_accepts"), F.lit(True).alias("_asked"))
        )
        .withColumn("_seen", F.when(~F.col("_asked"), F.col("ts")))
    )
    results = {"_listed": (F.max, "_accepts"), "last_seen": (F.max, "_seen")}
    ordinary, heavy = running(*split_hot(rows, "id", epoch_micros(rows, "ts"), tie="seq"), "id", ["ts", "seq"], results)
    columns = ["id", "ts", *results, "_asked"]
    found = ordinary.select(*columns).unionByName(heavy.select(*columns)).filter("_asked")
    known = F.col("_listed") & F.col("id").isNotNull() & F.col("ts").isNotNull()
    found = found.select("id", F.col("ts").alias("as_of"), F.when(known, F.col("last_seen")).alias("last_seen"))
    silence = epoch_micros(found, "as_of") - epoch_micros(found, "last_seen")
    state = F.when(silence <= micros(timeout), "ALIVE").when(silence.isNotNull(), "DEAD")
    return found.withColumn("state", state)
