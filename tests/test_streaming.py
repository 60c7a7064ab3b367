from __future__ import annotations

from datetime import timedelta
from types import SimpleNamespace

import pytest
from logs import LOG_TYPE, WholeLog, at, log, random_rows
from pyspark.sql import functions as F

from conftest import SMALL
from rollcall.operators import liveness, registry
from rollcall.operators.replay import replay
from rollcall.sources import heartbeats, message_log, new_folder, registrations, table, table_stream
from rollcall.streaming import (
    run_alive_spans,
    run_registration_outcomes,
    run_replay,
    run_updates,
    stream_last_seen,
)

ALL = ("register", "heartbeat", "lost")
MINUTE = timedelta(minutes=1)


class Feed:
    """A directory of files, each read as one micro-batch in order of writing."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.written = spark, folder, 0

    def add(self, rows, files=1):
        frame = log(self.spark, rows).collect()
        size = -(-len(frame) // files)
        for start in range(0, len(frame), size):
            piece = self.spark.createDataFrame(
                [(row.seq + self.written, *row[1:]) for row in frame[start : start + size]],
                LOG_TYPE,
            )
            piece.coalesce(1).write.mode("append").parquet(f"{self.folder}/log.parquet")
        self.written += len(rows)

    def stream(self):
        return table_stream(self.spark, str(self.folder), "log", max_files_per_trigger=1)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def outcomes(frame):
    return [row.outcome for row in frame.orderBy("seq").collect()]


def test_registrations_over_micro_batches_equal_batch(spark, feed):
    rows = random_rows(21, 300, 8, 3, ("register",))
    feed.add(rows, files=4)
    streamed = run_registration_outcomes(feed.stream())
    batch = registry.registration_outcomes(log(spark, rows))
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert outcomes(streamed) == WholeLog(rows).outcomes


def test_replay_goes_on_from_its_checkpoint(spark, feed, tmp_path):
    rows = random_rows(22, 240, 5, 4, ALL)
    folder = str(tmp_path / "job")
    feed.add(rows[:130], files=2)
    first = run_replay(feed.stream(), folder)
    assert first.count() == 130
    feed.add(rows[130:], files=2)
    both = run_replay(feed.stream(), folder)
    assert outcomes(both) == WholeLog(rows).outcomes


def test_time_rules_within_a_run_and_arrival_across_runs(feed, tmp_path):
    folder = str(tmp_path / "job")
    feed.add([(9, "register", "late-stamp", "h")])
    feed.add([(1, "register", "early-stamp", "h"), (2, "register", "late-stamp", "h")])
    found = run_registration_outcomes(feed.stream(), folder)
    assert outcomes(found) == ["DUPLICATE_ADDRESS", "REGISTERED", "DUPLICATE_ADDRESS"]
    feed.add([(0, "register", "earlier", "h"), (0, "register", "early-stamp", "h"), (0, "register", "other", "g")])
    again = run_registration_outcomes(feed.stream(), folder)
    assert outcomes(again)[3:] == ["DUPLICATE_ADDRESS", "DUPLICATE_ID", "REGISTERED"]
    assert run_registration_outcomes(feed.stream(), folder).count() == again.count() == 6


@pytest.mark.parametrize("files", [1, 2, 6])
def test_the_cut_into_micro_batches_has_no_bearing(spark, tmp_path, files):
    events = table(spark, SMALL, "events")
    for part in range(6):  # interleaved in time
        events.where(F.col("event_id") % 6 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = lambda: table_stream(spark, str(tmp_path), "events", max_files_per_trigger=files)
    same = lambda found, expected: sorted(map(str, found.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert same(run_registration_outcomes(registrations(stream())), registry.registration_outcomes(registrations(events)))
    assert same(run_replay(message_log(stream())), replay(message_log(events)))
    hb = heartbeats(events)
    spans = run_alive_spans(heartbeats(stream()), timedelta(hours=24))
    assert spans.agg(F.sum("events")).first()[0] == hb.count()
    everyone = hb.groupBy("id").agg(F.min(F.struct("ts", "seq", "address")).alias("f")).select((F.col("f.seq") * 0 - 1).alias("seq"), (F.col("f.ts") - F.expr("INTERVAL 100 DAYS")).alias("ts"), "id", F.col("id").alias("address"))
    batch = liveness.alive_spans(everyone, hb, timedelta(hours=24)).where("started_at >= '2024-01-01'")
    assert same(spans, batch)


def test_last_seen_is_updated(feed, tmp_path):
    folder = str(tmp_path / "job")
    feed.add([(1, "heartbeat", "a", "h"), (5, "heartbeat", "b", "h"), (3, "heartbeat", "a", "h")])

    def latest():
        seen = run_updates(stream_last_seen(feed.stream()), "id", "last_seen", "s2", folder)
        return {row.id: row.last_seen for row in seen.collect()}

    assert latest() == {"a": at(3), "b": at(5)}
    feed.add([(9, "heartbeat", "a", "h"), (2, "heartbeat", "b", "h")])
    assert latest() == {"a": at(9), "b": at(5)}


def test_last_seen_is_compacted(spark, feed, tmp_path):
    folder, beat = tmp_path / "job", "heartbeat"

    def seen(**limits):
        found = run_updates(stream_last_seen(feed.stream()), "id", "last_seen", "s2", str(folder), **limits)
        return found, {row.id: row.last_seen for row in found.collect()}

    feed.add([(n, beat, f"c{n}", "h") for n in range(40)], files=5)
    expected = {f"c{n}": at(n) for n in range(40)}
    found, first = seen()
    # All is new, so all is compacted, and what is read is the snapshot alone.
    assert first == expected and all("/snapshots/version=1/" in path for path in found.inputFiles())
    feed.add([(100, beat, "c3", "h"), (0.5, beat, "c7", "h")])
    found, second = seen()
    expected["c3"] = at(100)
    assert second == expected and any("/changes/after=1/" in path for path in found.inputFiles())
    # A compaction that broke off has no line in versions and changes no answer.
    spark.createDataFrame([("wrong", at(1))], "id string, last_seen timestamp_ntz").write.parquet(f"{folder}/snapshots/version=2")
    assert seen()[1] == expected
    for turn in range(6):
        feed.add([(200 + turn, beat, f"c{turn}", "h")])
        expected[f"c{turn}"] = at(200 + turn)
        found, now = seen(epochs=3)
        assert now == expected and len({path.split("/part-")[0] for path in found.inputFiles()}) <= 4
    assert len(list((folder / "snapshots").iterdir())) <= 2 and len(list((folder / "changes").iterdir())) <= 2
    feed.add([(300, beat, "new", "h")])
    assert seen(share=0.0)[1] == expected | {"new": at(300)}


def test_spans_of_runs_are_merged(feed, tmp_path):
    beat, folder = "heartbeat", str(tmp_path / "job")
    feed.add([(0, beat, "a", "h"), (60, beat, "a", "h"), (121, beat, "a", "h")])

    def found():
        spans = run_alive_spans(feed.stream(), MINUTE, folder)
        return {tuple(r) for r in spans.select("id", "started_at", "ended_at", "events").collect()}

    # Exactly one timeout apart stays together, one second more does not.
    assert found() == {("a", at(0), at(120), 2), ("a", at(121), at(181), 1)}
    feed.add([(1000, beat, "b", "h"), (90, beat, "a", "h"), (175, beat, "a", "h")])  # the second closes a gap, late
    assert found() == {("a", at(0), at(235), 5), ("b", at(1000), at(1060), 1)}
    assert found() == {("a", at(0), at(235), 5), ("b", at(1000), at(1060), 1)}


def session_with(shared, master):
    settings = {"spark.checkpoint.dir": shared}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: settings.get(name) or default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_workspace_is_the_shared_folder_the_session_names():
    cluster = session_with("hdfs://shared/jobs/", "spark://m:7077")
    assert new_folder(cluster, "x").startswith("hdfs://shared/jobs/x-")
    assert new_folder(cluster, "x") != new_folder(cluster, "x")


def test_workspace_is_temporary_only_in_local_sessions(spark):
    assert new_folder(spark, "x") != new_folder(spark, "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        new_folder(session_with(None, "yarn"), "x")
