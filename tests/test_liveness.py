from __future__ import annotations

from datetime import timedelta

import pytest
from logs import at, log, split
from pyspark.sql import functions as F

from rollcall.operators import liveness

HEARTBEAT, REGISTER = "heartbeat", "register"
MINUTE = timedelta(seconds=60)


def literal(when):
    return F.lit(str(when)).cast("timestamp_ntz")


@pytest.fixture(params=[1_000_000, 1])
def logs(spark, hot_from, request):
    hot_from(request.param)
    return split(
        log(
            spark,
            [
                (0, HEARTBEAT, "a", "h"),  # before acceptance
                (10, REGISTER, "a", "h"),
                (20, REGISTER, "b", "k"),  # never beats
                (70, HEARTBEAT, "a", "h"),  # exactly one timeout later
                (130.001, HEARTBEAT, "a", "h"),  # just over
                (140, HEARTBEAT, "z", "z"),  # never accepted
                (145.001, HEARTBEAT, "a", "h"),
                (400, HEARTBEAT, "a", "h"),
            ],
        )
    )


def test_silence_of_exactly_the_timeout_is_alive(logs):
    def states(seconds):
        rows = liveness.liveness(*logs, literal(at(seconds)), MINUTE).collect()
        return {row.id: row.state for row in rows}

    assert states(460) == {"a": "ALIVE", "b": "DEAD"}
    assert states(460.000001) == {"a": "DEAD", "b": "DEAD"}
    assert liveness.TIMEOUT == MINUTE


def test_gaps_start_at_acceptance_and_count_missed_beats(logs):
    rows = liveness.heartbeat_gaps(*logs, MINUTE).orderBy("seq").collect()
    assert [(row.seq, row.gap_ms, row.missed) for row in rows] == [
        (3, 60000, 3), (4, 60001, 3), (6, 15000, 0), (7, 254999, 15)
    ]


def test_spans_break_only_beyond_the_timeout(logs):
    rows = liveness.alive_spans(*logs, MINUTE).orderBy("id", "started_at").collect()
    assert [tuple(row) for row in rows] == [
        ("a", at(10), at(70), at(130), 2),
        ("a", at(130.001), at(145.001), at(205.001), 2),
        ("a", at(400), at(400), at(460), 1),
        ("b", at(20), at(20), at(80), 1),
    ]


def test_nothing_in_nothing_out(spark):
    empty = split(log(spark, []))
    assert liveness.liveness(*empty, literal(at(0))).count() == 0
    assert liveness.heartbeat_gaps(*empty).count() == 0
    assert liveness.alive_spans(*empty).count() == 0
