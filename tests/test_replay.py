from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from conftest import SMALL
from logs import WholeLog, log, random_rows, split

from rollcall.functions.ownership import NO_OWNER, answer, apply_effects, compose, effects
from pyspark.sql import functions as F

from rollcall.functions.clock import epoch_micros
from rollcall.operators import registry, replay
from rollcall.plans import skew
from rollcall.sources import message_log, table

HEARTBEAT, LOST, REGISTER = "heartbeat", "lost", "register"
ALL = (REGISTER, HEARTBEAT, LOST)

messages = st.lists(st.tuples(st.sampled_from(ALL), st.sampled_from("abcd")), max_size=14)


def outcomes(frame):
    return [row.outcome for row in frame.orderBy("seq").collect()]


@settings(max_examples=1500, deadline=None)
@given(messages)
def test_effects_of_a_stretch_equal_running_it(stretch):
    table = {(effect[0], effect[1]): effect for effect in effects(stretch)}
    names = "abcde"  # e never occurs
    starts = [NO_OWNER] + [
        (owner, lost, dead)
        for owner in names
        for lost in (False, True)
        for dead in [None, *names]
        if dead != owner
    ]
    for start in starts:
        state = start
        for kind, sender in stretch:
            _, state = answer(state, kind, sender)
        assert apply_effects(start, table) == state


@settings(max_examples=1500, deadline=None)
@given(st.lists(messages, min_size=2, max_size=4), st.integers(0, 3))
def test_composed_effects_equal_running_the_stretches(stretches, group_at):
    tables = [{(effect[0], effect[1]): effect for effect in effects(stretch)} if stretch else {} for stretch in stretches]
    from_left = {}
    for table in tables:
        from_left = compose(from_left, table)
    at = min(group_at, len(tables))
    left, right = {}, {}
    for table in tables[:at]:
        left = compose(left, table)
    for table in reversed(tables[at:]):
        right = compose(table, right)
    names = "abcde"
    starts = [NO_OWNER] + [
        (owner, lost, dead) for owner in names for lost in (False, True) for dead in [None, *names] if dead != owner
    ]
    assert len(from_left) <= 2 * len(names) + 3
    for start in starts:
        state = start
        for kind, sender in [message for stretch in stretches for message in stretch]:
            _, state = answer(state, kind, sender)
        assert apply_effects(start, from_left) == apply_effects(start, compose(left, right)) == state


def test_each_branch(spark):
    rows = [
        (1, LOST, "a", "h"),  # nobody there
        (2, REGISTER, "a", "h"),
        (3, REGISTER, "b", "h"),  # owner lives
        (4, LOST, "b", "h"),  # not the owner
        (5, LOST, "a", "h"),
        (6, REGISTER, "a", "h"),  # owner again, even when unknown
        (7, HEARTBEAT, "a", "h"),  # updates, stays unknown
        (8, REGISTER, "b", "h"),  # takes over; a is dead and listed
        (9, HEARTBEAT, "a", "h"),
        (10, HEARTBEAT, "c", "h"),
        (11, REGISTER, "b", "h"),  # owner: purges nothing
        (12, HEARTBEAT, "a", "h"),
        (13, REGISTER, "c", "h"),  # refused, but purges a
        (14, HEARTBEAT, "a", "h"),
    ]
    found = replay.replay(log(spark, rows))
    assert outcomes(found) == [
        "NO_EFFECT", "REGISTERED", "DUPLICATE_ADDRESS", "NO_EFFECT", "MARKED_UNKNOWN",
        "DUPLICATE_ID", "UPDATED", "REGISTERED", "RECONNECT", "IGNORED", "DUPLICATE_ID",
        "RECONNECT", "DUPLICATE_ADDRESS", "IGNORED",
    ]
    replaced = {row.seq: row.replaced for row in found.collect() if row.replaced}
    assert replaced == {7: "a"}


def test_nothing_to_replay(spark):
    assert replay.replay(log(spark, [])).count() == 0
    assert replay.replay_registry(log(spark, [])).count() == 0


@pytest.mark.parametrize("hot_rows", [1_000_000, 25, 1])
@pytest.mark.parametrize(("seed", "ids"), [(1, 2), (2, 4), (3, 9)])
def test_replay_agrees_with_whole_log(spark, hot_from, hot_rows, seed, ids):
    hot_from(hot_rows)
    rows = random_rows(seed, 600, 9, ids, ALL)
    whole = WholeLog(rows)
    made = log(spark, rows)
    assert outcomes(replay.replay(made)) == whole.outcomes
    listed = {(row.id, row.address, row.state) for row in replay.replay_registry(made).collect()}
    assert listed == {(one["id"], one["at"], one["state"]) for one in whole.listed}


@pytest.mark.parametrize("cells_in_block", [1, 3, 50])
@pytest.mark.parametrize("beats_alone", [False, True])
def test_any_size_of_block(spark, hot_from, monkeypatch, cells_in_block, beats_alone):
    hot_from(1)
    monkeypatch.setattr(replay, "BLOCK_CELLS", cells_in_block)
    rows = random_rows(31, 500, 2, 5, ALL)
    if beats_alone:  # a long stretch of cells, and whole blocks, in which no state changes
        rows = [row if at < 60 or at > 440 else (row[0], HEARTBEAT, *row[2:]) for at, row in enumerate(rows)]
    assert outcomes(replay.replay(log(spark, rows))) == WholeLog(rows).outcomes


def test_no_task_reads_all_effects_of_a_hot_address(spark, hot_from):
    """Of 2,000 cells with five effects or so each, the walk over blocks reads a row for each block and id."""
    hot_from(64)
    rows = [(at, (REGISTER, LOST)[at % 2], "abc"[at % 3], "h") for at in range(4000)]
    made = log(spark, rows)
    _, heavy = skew.split_hot(made, "address", epoch_micros(made, "ts"), tie="seq")
    by_cell = heavy.repartition("address", skew.CELL).sortWithinPartitions("address", skew.CELL, "ts", "seq")
    kinds = f"address string, {skew.CELL} bigint, {replay._EFFECT_TYPE}"
    cells = by_cell.select("address", skew.CELL, "kind", "id").mapInArrow(replay._cell_effects, kinds)
    in_block = cells.withColumn("_block", F.expr(f"{skew.CELL} div {replay.BLOCK_CELLS}"))
    blocks = in_block.repartition("address", "_block").sortWithinPartitions("address", "_block", skew.CELL)
    composed = blocks.mapInArrow(replay._block_effects, f"address string, _block bigint, {replay._EFFECT_TYPE}")
    total, walked = cells.count(), composed.count()
    largest = max(row["count"] for row in in_block.groupBy("_block").count().collect())
    assert total > 4000 and walked < total / 40 and largest < total / 5
    assert outcomes(replay.replay(made)) == WholeLog(rows).outcomes


def test_without_losses_replay_is_the_plain_outcomes(spark):
    made = log(spark, random_rows(5, 500, 10, 3, (REGISTER, HEARTBEAT)))
    reg, hb = split(made)
    plain = registry.registration_outcomes(reg).select("seq", "outcome").union(
        registry.heartbeat_outcomes(reg, hb).select("seq", "outcome")
    )
    assert outcomes(replay.replay(made)) == outcomes(plain)


def test_further_columns_are_kept(spark):
    made = log(spark, [(1, REGISTER, "a", "h"), (2, LOST, "a", "h"), (3, REGISTER, "b", "h")])
    made = made.selectExpr("*", "seq * 100 AS memory")
    rows = {row.id: (row.state, row.memory) for row in replay.replay_registry(made).collect()}
    assert rows == {"a": ("DEAD", 0), "b": ("ALIVE", 200)}


def test_no_heartbeat_reaches_python(spark):
    events = table(spark, SMALL, "events")
    for job in (replay.replay, replay.replay_registry):
        frame = job(message_log(events))
        tree = frame._jdf.queryExecution().optimizedPlan().toString().split("\n")
        for at, line in enumerate(tree):
            if "MapInArrow" in line or "MapInPandas" in line:
                depth = len(line) - len(line.lstrip(" :+-"))
                below = []
                for later in tree[at + 1 :]:
                    if len(later) - len(later.lstrip(" :+-")) <= depth:
                        break
                    below.append(later)
                assert any("heartbeat" in x or "_cell_effects" in x or "_cell_starts" in x for x in below), line
