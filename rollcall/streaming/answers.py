"""Answers to a stream of messages, and spans of activity, each given as soon as nothing earlier can come.

The messages of an address wait in keyed state until the watermark has passed them, and are then answered in
``(ts, seq)`` order by the rule of the replay. State is the owner triple and the messages younger than the watermark: it does not grow with
history, and nothing is answered twice or read again. However the input is cut into micro-batches, and under any
trigger, answers are those of the batch replay, with two differences that a stream has: messages of the last ``delay`` before the
latest time seen are still waiting, and a message that comes after the watermark has passed its time is dropped, as Spark counts in
``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta
from itertools import islice
from operator import itemgetter

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollcall.functions.ownership import NO_OWNER, answer
from rollcall.operators.liveness import TIMEOUT
from rollcall.sources.workspace import new_folder

DELAY = timedelta(hours=1)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Messages of one address that are kept or given as one value.
PACK = 10_000
_NO_SEQ = -(2**63)
_PACKED = ("micros", "seq", "kind", "id")
_PACK = "micros array<long>, seq array<long>, kind array<string>, id array<string>"
_ANSWERS = "micros long, seq long, kind string, id string, outcome string, address string"


class OrderedAnswers(StatefulProcessor):
    """State of one address: its owner, and the messages that wait for the watermark.

    Messages wait in packs, columns of at most ``pack`` messages each, so a message costs its share of a call to the
    state. A pack that arrives is appended; those that wait already are read when a message of the address is due.
    """

    def __init__(self, pack: int = PACK) -> None:
        self.pack = pack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owner = handle.getValueState("owner", "owner string, lost boolean, dead string")
        self.waiting = handle.getListState("waiting", _PACK)

    def _packs(self, rows: Iterable[tuple]) -> Iterator[tuple[tuple, ...]]:
        rows = iter(rows)
        while some := list(islice(rows, self.pack)):
            yield tuple(zip(*some, strict=True))

    def _released(self, address: str, watermark: int) -> Iterator[pd.DataFrame]:
        """Answer what is before the watermark (ms), keep the rest, and come back when the first of it is due."""
        due, rest = [], []
        for pack in self.waiting.get():
            for message in zip(*pack, strict=True):
                (due if message[0] < watermark * 1000 else rest).append(message)
        if not due:
            return  # released by another timer; the one of the rest is set
        if rest:
            self.waiting.put(list(self._packs(rest)))
            self.handle.registerTimer(min(x[0] for x in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        due.sort(key=itemgetter(0, 1))
        held = self.owner.get()
        state = tuple(held) if held is not None else NO_OWNER
        for pack in self._packs(due):
            outcomes = []
            for kind, sender in zip(*pack[2:], strict=True):
                outcome, state = answer(state, kind, sender)
                outcomes.append(outcome)
            yield pd.DataFrame(dict(zip(_PACKED, pack, strict=True)) | {"outcome": outcomes, "address": address})
        self.owner.update(state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, watermark = None, max(timerValues.getCurrentWatermarkInMs(), 0)
        for frame in rows:
            for pack in self._packs(zip(*(frame[name].tolist() for name in _PACKED), strict=True)):
                self.waiting.appendValue(pack)
                first = min(pack[0]) if first is None else min(first, *pack[0])
        if first < watermark * 1000:
            yield from self._released(key[0], watermark)
        else:
            self.handle.registerTimer(first // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._released(key[0], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_answers(log: DataFrame, delay: timedelta = DELAY) -> DataFrame:
    """Answers to a stream of ``seq, ts, kind, id, address``; append mode, state in RocksDB (set ``PROVIDER`` first).

    Messages without an address or a time are passed over.
    """
    rows = log.select("seq", F.col("ts").cast("timestamp").alias("ts"), "kind", "id", "address").where("address is not null and ts is not null")
    rows = rows.withWatermark("ts", f"{_milliseconds(delay)} milliseconds")
    # Pandas would make floats of whole numbers with nulls among them.
    rows = rows.withColumns({"micros": F.unix_micros("ts"), "seq": F.coalesce("seq", F.lit(_NO_SEQ))})
    answers = rows.groupBy("address").transformWithStateInPandas(OrderedAnswers(), _ANSWERS, "append", "eventTime")
    return answers.select(F.nullif("seq", F.lit(_NO_SEQ)).alias("seq"), F.timestamp_micros("micros").alias("ts"), "kind", "id", "address", "outcome")


def run_answers(log: DataFrame, delay: timedelta = DELAY, folder: str | None = None, **trigger) -> DataFrame:
    """Run a stream over what is available now (or by another ``trigger``) and return all answers given so far."""
    return run_appended(stream_answers(log, delay), "answers", folder, **trigger)


def stream_closed_spans(beats: DataFrame, timeout: timedelta = TIMEOUT, delay: timedelta = DELAY) -> DataFrame:
    """Spans of activity of a stream of ``id, ts``, each when it is closed: ``id, started_at, last_active, ended_at, events``; append mode.

    A span is closed when the watermark reaches its end, ``timeout`` after its last heartbeat: no heartbeat that is not late can
    join it. State is one open span of an id (or a few, while the watermark has not passed a silence), and leaves with the
    span. Heartbeats older than the watermark are dropped, as Spark counts; those without an id or a time are passed over. Silence of
    exactly the timeout does not end a span.
    """
    rows = beats.select("id", F.col("ts").cast("timestamp").alias("ts")).where("id is not null and ts is not null")
    rows = rows.withWatermark("ts", f"{_milliseconds(delay)} milliseconds")
    spans = rows.groupBy(F.session_window("ts", f"{_milliseconds(timeout)} milliseconds").alias("span"), "id").agg(
        F.max("ts").alias("last_active"), F.count(F.lit(1)).alias("events")
    )
    return spans.select("id", F.col("span.start").alias("started_at"), "last_active", F.col("span.end").alias("ended_at"), "events")


def run_closed_spans(beats: DataFrame, timeout: timedelta = TIMEOUT, delay: timedelta = DELAY, folder: str | None = None, **trigger) -> DataFrame:
    """Run a stream over what is available now (or by another ``trigger``) and return all spans closed so far."""
    return run_appended(stream_closed_spans(beats, timeout, delay), "closed-spans", folder, **trigger)


def _milliseconds(length: timedelta) -> int:
    return int(length / timedelta(milliseconds=1))


def run_appended(stream: DataFrame, name: str, folder: str | None = None, **trigger) -> DataFrame:
    """Run an append-mode stream into files and return all rows that runs in ``folder`` have given.

    The same ``folder`` continues where the run before stopped; the file sink counts each micro-batch's files once, so a
    batch that is run again after a loss adds nothing.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows")
        query = writer.option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
        query.processAllAvailable() if trigger else query.awaitTermination()
        query.stop()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    try:
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], stream.schema)
        raise
