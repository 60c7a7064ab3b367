"""Streamed answers equal the batch replay up to the watermark, however the input is cut."""

from __future__ import annotations

import random
from datetime import timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from logs import WholeLog, at, log, random_rows
from pyspark.sql import functions as F

from conftest import SMALL
from rollcall.operators.replay import replay
from rollcall.sources import message_log, table, table_stream
from rollcall.streaming import run_answers, run_closed_spans, stream_closed_spans
from rollcall.streaming.answers import OrderedAnswers

HOUR = timedelta(hours=1)


def told(frame):
    return sorted((r.seq, r.kind, r.outcome) for r in frame.collect())


@pytest.mark.parametrize("files", [2, 6])
def test_any_cut_gives_the_answers_of_the_replay(spark, tmp_path, files):
    events = table(spark, SMALL, "events")
    for part in range(6):  # consecutive in time, each file shuffled
        events.where(F.col("event_id").between(F.lit(part * 167), F.lit(part * 167 + 166))).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = table_stream(spark, str(tmp_path), "events", max_files_per_trigger=files)
    found = run_answers(message_log(stream), HOUR)
    latest = events.agg(F.date_trunc("MILLISECOND", F.max("ts"))).first()[0]
    expected = replay(message_log(events)).where(F.col("ts") < F.lit(latest - HOUR))
    assert told(found) == told(expected) and found.count() > 900


def write(spark, folder, rows, first):
    frame = log(spark, rows)
    frame.withColumn("seq", F.col("seq") + first).coalesce(1).write.mode("append").parquet(f"{folder}/log.parquet")


def test_answers_leave_with_each_run_and_late_messages_are_dropped(spark, tmp_path):
    folder, minute = str(tmp_path / "job"), timedelta(minutes=1)
    stream = lambda: table_stream(spark, str(tmp_path), "log", max_files_per_trigger=1)
    write(spark, tmp_path, [(0, "register", "a", "h"), (50, "register", "b", "h"), (100, "lost", "a", "h"), (200, "register", "b", "h")], 0)
    found = run_answers(stream(), minute, folder)
    # The watermark is at 140: what is later waits.
    assert told(found) == [(0, "register", "REGISTERED"), (1, "register", "DUPLICATE_ADDRESS"), (2, "lost", "MARKED_UNKNOWN")]
    # 150 comes late but not too late; 10 is dropped.
    write(spark, tmp_path, [(150, "heartbeat", "b", "h"), (10, "register", "c", "h"), (300, "heartbeat", "a", "h"), (400, "heartbeat", "b", "g")], 10)
    found = run_answers(stream(), minute, folder)
    assert told(found)[3:] == [(3, "register", "REGISTERED"), (10, "heartbeat", "IGNORED"), (12, "heartbeat", "RECONNECT")]
    assert told(run_answers(stream(), minute, folder)) == told(found)


def test_a_trigger_by_time_gives_the_same(spark, tmp_path):
    rows = random_rows(31, 120, 5, 3, ("register", "heartbeat", "lost"))
    write(spark, tmp_path, rows, 0)
    write(spark, tmp_path, [(10**6, "heartbeat", "end", "end")], len(rows))
    stream = table_stream(spark, str(tmp_path), "log", max_files_per_trigger=1)
    found = run_answers(stream, timedelta(seconds=1), processingTime="0 seconds")
    assert [x[2] for x in told(found)] == WholeLog(rows).outcomes
    assert found.where(F.col("ts") >= F.lit(at(10**6))).isEmpty()


def test_waiting_messages_are_kept_in_packs(spark, tmp_path):
    rows = random_rows(47, 200, 4, 3, ("register", "heartbeat", "lost"))
    for part in range(2):
        write(spark, tmp_path, rows[part * 100 : part * 100 + 100], part * 100)
    folder = str(tmp_path / "job")
    # The watermark passes none of them.
    assert run_answers(table_stream(spark, str(tmp_path), "log", max_files_per_trigger=1), timedelta(days=1), folder).isEmpty()
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{folder}/checkpoint")
    packs = [tuple(r[0]) for r in state.select("list_element").collect()]
    assert len(packs) <= 2 * 4  # an address has at most one for each micro-batch, not one for each message
    assert sorted(seq for pack in packs for seq in pack[1]) == list(range(200))


class Kept:
    """The state of one address, in memory."""

    def __init__(self):
        self.values, self.owner, self.timers, self.reads = [], None, set(), 0

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.owner, update=lambda value: setattr(self, "owner", value))

    def getListState(self, name, schema):
        return SimpleNamespace(get=self._read, put=lambda values: self._set(list(values)), appendValue=self.values.append, clear=lambda: self._set([]))

    def registerTimer(self, at):
        self.timers.add(at)

    def _read(self):
        self.reads += 1
        return iter(list(self.values))

    def _set(self, values):
        self.values[:] = values


def frame(rows):
    return pd.DataFrame(rows, columns=["seq", "kind", "id", "micros"])


def test_messages_without_a_number_come_first(spark, tmp_path):
    log(spark, [(5, "register", "a", "h"), (5, "register", "b", "h"), (900, "heartbeat", "a", "h")]).withColumn("seq", F.expr("nullif(seq, 1) + 9007199254740993")).coalesce(1).write.parquet(f"{tmp_path}/log.parquet")
    found = run_answers(table_stream(spark, str(tmp_path), "log"), timedelta(minutes=1)).collect()
    assert sorted((r.id, r.seq, r.outcome) for r in found) == [("a", 9007199254740993, "DUPLICATE_ADDRESS"), ("b", None, "REGISTERED")]


@pytest.mark.parametrize("pack", [1, 3, 1000])
def test_packs_of_any_size_and_any_cut_give_the_same(pack):
    rows = [(when, kind, name, "h") for when, kind, name, _ in random_rows(53, 300, 1, 3, ("register", "heartbeat", "lost"))]
    kept, job, found = Kept(), OrderedAnswers(pack), []
    job.init(kept)
    chance, watermark, put = random.Random(5), 0, 0
    while put < len(rows):
        some = [(seq, kind, name, int(when * 10**6)) for seq, (when, kind, name, _) in enumerate(rows)][put : put + 17]
        put += len(some)
        chance.shuffle(some)
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda at=watermark: at)
        found += job.handleInputRows(("h",), iter([frame(some[:9]), frame(some[9:])]), times)
        # All before the next message is passed, or all given so far.
        watermark = int(rows[put][0] * 1000) if put < len(rows) else 10**12
        if chance.random() < 0.7:
            times = SimpleNamespace(getCurrentWatermarkInMs=lambda at=watermark: at)
            for at in sorted(x for x in kept.timers if x <= watermark):
                kept.timers.remove(at)
                found += job.handleExpiredTimer(("h",), times, None)
        assert all(len(x[0]) <= pack for x in kept.values)
    found += job.handleExpiredTimer(("h",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**12), None)
    answers = [x for r in found for x in zip(r["seq"], r["outcome"], strict=True)]
    assert answers == list(enumerate(WholeLog(rows).outcomes))
    assert not kept.values and all(len(r) <= pack for r in found)


def test_arrivals_do_not_read_what_waits():
    kept, job = Kept(), OrderedAnswers()
    job.init(kept)
    for seq in range(50):
        rows = iter([frame([(seq, "register", "a", seq + 1)])])
        assert list(job.handleInputRows(("h",), rows, SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))) == []
    assert kept.reads == 0 and len(kept.values) == 50 and kept.timers == {1}


@pytest.mark.parametrize("files", [1, 4])
def test_closed_spans_equal_the_batch_for_any_cut(spark, tmp_path, files):
    rows = [(s, "heartbeat", n, "h") for n, times in {"a": (0, 60, 121, 181, 600), "b": (30, 90, 151, 900), "c": (10,), "d": (2000,)}.items() for s in times]
    rows.sort()
    for k in range(4):  # interleaved within what the delay allows
        write(spark, tmp_path, rows[k * 3 : k * 3 + 3][::-1], 100 * k)
    spans = run_closed_spans(table_stream(spark, str(tmp_path), "log", max_files_per_trigger=files), timedelta(seconds=60), timedelta(seconds=300))
    found = sorted((r.id, r.started_at, r.last_active, r.ended_at, r.events) for r in spans.collect())
    # Exactly one timeout apart stays together, one second more does not; d's span is still open.
    expected = [("a", 0, 60, 2), ("a", 121, 181, 2), ("a", 600, 600, 1), ("b", 30, 90, 2), ("b", 151, 151, 1), ("b", 900, 900, 1), ("c", 10, 10, 1)]
    assert found == [(n, at(s), at(e), at(e + 60), k) for n, s, e, k in expected]


def test_state_holds_open_spans_only(spark, tmp_path):
    folder = str(tmp_path / "job")
    for k in range(3):
        write(spark, tmp_path, [(10_000 * k + s, "heartbeat", f"n{s}", "h") for s in range(50)], 100 * k)
    seen = []
    for _ in range(2):
        stream = stream_closed_spans(table_stream(spark, str(tmp_path), "log", max_files_per_trigger=1), timedelta(seconds=60), timedelta(seconds=1))
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{folder}/c").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        seen += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert seen and max(seen) <= 100 and seen[-1] <= 50
