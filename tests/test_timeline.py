"""The fleet and single containers as of many times, against one time after the other."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from logs import at, log, random_rows, split
from pyspark.sql import functions as F

from rollcall.operators import liveness, timeline
from rollcall.operators.registry import registry

MINUTE = timedelta(seconds=60)
STEP = timedelta(microseconds=1)


def _seen(reg, hb):
    """Times of acceptance and of later heartbeats by id, and memory by id, in plain Python."""
    accepted = {r.id: r for r in registry(reg).collect()}
    times = {name: [r.accepted_at] for name, r in accepted.items()}
    for r in hb.collect():
        if r.id in accepted and (r.ts, r.seq) > (accepted[r.id].accepted_at, accepted[r.id].accepted_seq):
            times[r.id].append(r.ts)
    return times, {name: r.memory for name, r in accepted.items()}


@pytest.fixture(params=[1_000_000, 40])
def logs(spark, hot_from, request):
    hot_from(request.param)
    reg, hb = split(log(spark, random_rows(5, 700, 5, 3, ("register", "heartbeat", "heartbeat", "heartbeat"))))
    request_columns = {"memory": F.lit(512) + F.col("seq").cast("int") % 7, "host": F.lit("h"), "port": F.lit(1), "web_ui_port": F.lit(2), "public_address": F.lit("p")}
    return reg.withColumns(request_columns), hb


def _asked(times):
    """Times that matter: each one seen, the end of its silence, and a microsecond on either side."""
    every = {t + d for seen in times.values() for t in seen for d in (timedelta(0), MINUTE, MINUTE + STEP, -STEP)}
    return sorted(every)


def test_fleet_at_each_time(spark, logs):
    times, memory = _seen(*logs)
    asked = _asked(times) + [at(-500)]
    frame = spark.createDataFrame([(t, "x") for t in asked + asked[:50]] + [(None, "y")], "as_of timestamp_ntz, alive string").repartition(3)
    found = timeline.fleet_at(*logs, frame, MINUTE).collect()
    expected = {}
    for t in asked:
        seen = {name: max((x for x in every if x <= t), default=None) for name, every in times.items()}
        alive = [name for name, last in seen.items() if last is not None and t - last <= MINUTE]
        expected[t] = (len(alive), sum(memory[name] for name in alive), sum(every[0] <= t for every in times.values()))
    assert len(found) == len(expected) and {r.as_of: (r.alive, r.memory, r.listed) for r in found} == expected


def test_state_at_each_question(spark, logs):
    times, _ = _seen(*logs)
    draw = random.Random(3)
    names = [*times, "never", None]
    asked = [(draw.choice(names), t) for t in _asked(times)] + [(next(iter(times)), None), (None, None)]
    asked += asked[:20]
    found = timeline.state_at(*logs, spark.createDataFrame(asked, "id string, as_of timestamp_ntz").repartition(3), MINUTE).collect()
    expected = []
    for name, t in asked:
        last = max((x for x in times.get(name, ()) if t is not None and x <= t), default=None)
        expected.append((name, t, last, None if last is None else "ALIVE" if t - last <= MINUTE else "DEAD"))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_agrees_with_liveness_as_of_one_time(spark, logs):
    when = at(3000)
    states = {r.id: r.state for r in liveness.liveness(logs[0], logs[1].filter(F.col("ts") <= F.lit(when)), F.lit(str(when)).cast("timestamp_ntz"), MINUTE).collect()}
    row = timeline.fleet_at(*logs, spark.createDataFrame([(when,)], "as_of timestamp_ntz"), MINUTE).first()
    assert row.alive == sum(s == "ALIVE" for s in states.values())


def test_nothing_in_nothing_out(spark):
    empty = split(log(spark, []))
    request = {"memory": F.lit(1), "host": F.lit("h"), "port": F.lit(1), "web_ui_port": F.lit(2), "public_address": F.lit("p")}
    empty = (empty[0].withColumns(request), empty[1])
    none = spark.createDataFrame([], "id string, as_of timestamp_ntz")
    assert timeline.fleet_at(*empty, none).count() == 0 and timeline.state_at(*empty, none).count() == 0
    asked = spark.createDataFrame([("a", at(1))], "id string, as_of timestamp_ntz")
    assert timeline.fleet_at(*empty, asked).first()[1:] == (0, 0, 0)
    assert tuple(timeline.state_at(*empty, asked).first()) == ("a", at(1), None, None)
