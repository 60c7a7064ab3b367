"""Replay of a log in which owners can be lost and replaced.

The log has ``seq, ts, kind, id, address`` with kind register, heartbeat or lost;
``lost`` marks the owner of an address as UNKNOWN, after which the next other id
to register takes the address over. That event is this library's input: it stands
for a state the recovery protocol provides for.

The next owner depends on the previous one, so no fixed window expresses this. The
registrations and losses of each address are folded in order instead, as one pass over
sorted partitions: state is three values, and no group is ever held in memory. Heartbeats,
which are nearly all of a log, never change the state and never reach Python: a window
gives each the state after the latest message before it.

A hot address (see ``plans.skew``) is cut into cells. A first pass reduces each cell
to its effect on any state. Effects are composed by blocks of cells, the blocks of an address are walked in
order to find the state each starts from, then all blocks at once are walked for the state each cell starts
from, and the fold then runs on all cells at once. So no task reads more than the effects of one block, or one
composed effect for each block of an address.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rollcall.functions.clock import epoch_micros
from rollcall.functions.ownership import (
    DUPLICATE_ADDRESS,
    IGNORED,
    MARKED_UNKNOWN,
    NO_OWNER,
    RECONNECT,
    REGISTERED,
    UPDATED,
    answer,
    apply_effects,
    compose,
    effects,
)
from rollcall.plans.skew import CELL, IS_CARRY, split_hot, with_carry
from rollcall.sources.fleet_log import HEARTBEAT

COLUMNS = ["seq", "ts", "kind", "id", "address"]
_STATE = ["owner", "lost", "dead"]
# The state after a message, as far as heartbeats depend on it.
_AFTER = ["owner_after", "dead_after"]
_EFFECT_COLUMNS = [
    "start", "start_owner", "owner", "lost", "dead_from", "dead_id", "sole_registrant"
]
_EFFECT_TYPE = ", ".join(
    f"{name} {'boolean' if name == 'lost' else 'string'}" for name in _EFFECT_COLUMNS
)

# Cells in a block: as many as there are blocks where an address has the most cells.
BLOCK_CELLS = 256
_BLOCK = "_block"
# Start of the row that names a cell and has no effect, and of the row that brings a state.
_CELL_ROW, _STATE_ROW = "cell", "state"

Batches = Iterator[pa.RecordBatch]


def _values(batch: pa.RecordBatch, name: str) -> list:
    """A column as Python values; by way of numpy, which is far quicker than Arrow's own."""
    return batch.column(name).to_numpy(zero_copy_only=False).tolist()


def _groups(batch: pa.RecordBatch, keys: list[str]) -> list:
    columns = [_values(batch, name) for name in keys]
    return columns[0] if len(keys) == 1 else list(zip(*columns))


def _answered(keys: list[str], kept: list[str], resumes: bool) -> Callable[[Batches], Batches]:
    """Fold over batches sorted by ``keys`` and order; adds outcome and replaced id."""

    def run(batches: Batches) -> Batches:
        current = None
        state = NO_OWNER
        for batch in batches:
            carries = _values(batch, IS_CARRY) if resumes else None
            given = list(zip(*[_values(batch, name) for name in _STATE])) if resumes else None
            rows = zip(_groups(batch, keys), _values(batch, "kind"), _values(batch, "id"))
            outcomes = [None] * batch.num_rows
            replaced = [None] * batch.num_rows
            owners, dead = [None] * batch.num_rows, [None] * batch.num_rows
            for at, (group, kind, sender) in enumerate(rows):
                if group != current:
                    current, state = group, NO_OWNER
                if resumes and carries[at]:
                    state = given[at]
                    continue
                owner = state[0]
                outcome, state = answer(state, kind, sender)
                outcomes[at] = outcome
                owners[at], dead[at] = state[0], state[2]
                if outcome == REGISTERED:
                    replaced[at] = owner
            arrays = [batch.column(name) for name in kept]
            arrays += [pa.array(values, pa.string()) for values in (outcomes, replaced, owners, dead)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "outcome", "replaced", *_AFTER])

    return run


def _effect_batch(rows: list[tuple], place: str) -> pa.RecordBatch:
    types = [pa.string(), pa.int64()]
    types += [pa.bool_() if name == "lost" else pa.string() for name in _EFFECT_COLUMNS]
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, of) for values, of in zip(columns, types)],
        ["address", place, *_EFFECT_COLUMNS],
    )


def _cell_effects(batches: Batches) -> Batches:
    """One row per effect of each ``(address, cell)``; input sorted by both and order.

    Only the messages of one cell are held at a time.
    """
    current, messages = None, []
    for batch in batches:
        done = []
        rows = zip(_groups(batch, ["address", CELL]), _values(batch, "kind"), _values(batch, "id"))
        for group, kind, sender in rows:
            if group != current:
                if current is not None:
                    done += [current + effect for effect in effects(messages)]
                current, messages = group, []
            messages.append((kind, sender))
        yield _effect_batch(done, CELL)
    if current is not None:
        yield _effect_batch([current + effect for effect in effects(messages)], CELL)


def _block_effects(batches: Batches) -> Batches:
    """One row per effect of each ``(address, block)``, or one that names it; input sorted by both and cell."""
    named = (_CELL_ROW, *[None] * (len(_EFFECT_COLUMNS) - 1))
    current = cell = None
    whole: dict = {}
    table: dict = {}
    for batch in batches:
        done = []
        rows = zip(_groups(batch, ["address", _BLOCK]), _values(batch, CELL), *[_values(batch, name) for name in _EFFECT_COLUMNS])
        for group, row_cell, *effect in rows:
            if (group, row_cell) != (current, cell):
                whole, table = compose(whole, table), {}
                if group != current:
                    if current is not None:
                        done += [current + found for found in whole.values() or [named]]
                    whole = {}
                current, cell = group, row_cell
            if effect[0] != _CELL_ROW:
                table[effect[0], effect[1]] = tuple(effect)
        yield _effect_batch(done, _BLOCK)
    if current is not None:
        yield _effect_batch([current + found for found in compose(whole, table).values() or [named]], _BLOCK)


def _starts(keys: list[str], place: str) -> Callable[[Batches], Batches]:
    """The state each place of a group starts from; input sorted by the group's keys, state rows, and place."""

    def run(batches: Batches) -> Batches:
        current = at = None
        state = NO_OWNER
        table: dict = {}
        for batch in batches:
            starts = []
            rows = zip(_groups(batch, keys), _values(batch, "address"), _values(batch, place), *[_values(batch, name) for name in _EFFECT_COLUMNS])
            for group, address, row_at, *effect in rows:
                if group != current:
                    current, at, state, table = group, None, NO_OWNER, {}
                if effect[0] == _STATE_ROW:
                    state = (effect[2], effect[3], effect[5])
                    continue
                if row_at != at:
                    state = apply_effects(state, table)
                    at, table = row_at, {}
                    starts.append((address, at, *state))
                table[effect[0], effect[1]] = tuple(effect)
            types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            columns = zip(*starts) if starts else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, of) for values, of in zip(columns, types)],
                ["address", place, *_STATE],
            )

    return run


def _cell_starts(by_effect: DataFrame) -> DataFrame:
    """``address, cell`` and the state each cell starts from, from the effects of all cells."""
    state_type = "owner string, lost boolean, dead string"
    in_block = by_effect.withColumn(_BLOCK, F.call_function("div", F.col(CELL), F.lit(BLOCK_CELLS)))
    by_block = ["address", _BLOCK]
    composed = (
        in_block.repartition(*by_block)
        .sortWithinPartitions(*by_block, CELL)
        .mapInArrow(_block_effects, f"address string, {_BLOCK} bigint, {_EFFECT_TYPE}")
    )
    blocks = (
        composed.repartition("address")
        .sortWithinPartitions(*by_block)
        .mapInArrow(_starts(["address"], _BLOCK), f"address string, {_BLOCK} bigint, {state_type}")
    )
    brought = blocks.select(
        *by_block,
        F.lit(_STATE_ROW).alias("start"),
        "owner",
        "lost",
        F.col("dead").alias("dead_id"),
    )
    first = (F.col("start") == _STATE_ROW).desc()
    return (
        in_block.unionByName(brought, allowMissingColumns=True)
        .repartition(*by_block)
        .sortWithinPartitions(*by_block, first, CELL)
        .mapInArrow(_starts(by_block, CELL), f"address string, {CELL} bigint, {state_type}")
    )


def _output(rows: DataFrame, kept: list[str]) -> T.StructType:
    schema = T.StructType([rows.schema[name] for name in kept])
    schema = schema.add("outcome", "string").add("replaced", "string")
    for name in _AFTER:
        schema = schema.add(name, "string")
    return schema


def _with_heartbeats(answered: DataFrame, beats: DataFrame, keys: list[str]) -> DataFrame:
    """The answered messages and the heartbeats with their outcome; rows without a kind only bring a state."""
    rows = answered.unionByName(beats, allowMissingColumns=True)
    so_far = (
        Window.partitionBy(*keys)
        .orderBy(F.col("kind").isNull().desc(), "ts", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    state = F.last(F.when(~F.col("kind").eqNullSafe(HEARTBEAT), F.struct(*_AFTER)), ignorenulls=True)
    known = F.col("_state")
    beat = (
        F.when(F.col("id") == known["owner_after"], UPDATED)
        .when(F.col("id") == known["dead_after"], RECONNECT)
        .otherwise(IGNORED)
    )
    outcome = F.when(F.col("kind") == HEARTBEAT, beat).otherwise(F.col("outcome"))
    return (
        rows.withColumn("_state", state.over(so_far))
        .withColumn("outcome", outcome)
        .filter(F.col("kind").isNotNull())
    )


def _replay_hot(heavy: DataFrame, kept: list[str]) -> DataFrame:
    by_cell = ["address", CELL]
    beats = heavy.filter(F.col("kind") == HEARTBEAT)
    heavy = heavy.filter(F.col("kind") != HEARTBEAT)
    by_effect = (
        heavy.select(*by_cell, "ts", "seq", "kind", "id")
        .repartition(*by_cell)
        .sortWithinPartitions(*by_cell, "ts", "seq")
        .mapInArrow(_cell_effects, f"address string, {CELL} bigint, {_EFFECT_TYPE}")
    )
    # Cells with heartbeats need a start too; this row names the cell and has no effect.
    nothing = [
        F.lit(_CELL_ROW if name == "start" else None).cast("boolean" if name == "lost" else "string").alias(name)
        for name in _EFFECT_COLUMNS
    ]
    by_effect = by_effect.unionByName(beats.select(*by_cell).distinct().select(*by_cell, *nothing))
    starts = _cell_starts(by_effect)
    rows = with_carry(heavy, starts)
    kept_cell = [*kept, CELL]
    answered = (
        rows.repartition(*by_cell)
        .sortWithinPartitions(*by_cell, F.col(IS_CARRY).desc(), "ts", "seq")
        .mapInArrow(_answered(by_cell, kept_cell, resumes=True), _output(rows, kept_cell))
        .filter(F.col("outcome").isNotNull())
    )
    carried = starts.select(
        "address", CELL, F.col("owner").alias("owner_after"), F.col("dead").alias("dead_after")
    )
    return _with_heartbeats(
        answered.unionByName(carried, allowMissingColumns=True), beats, by_cell
    )


def replay(log: DataFrame) -> DataFrame:
    """Outcome of every message, and for an accepted one the id it replaced (if any).

    Registrations: REGISTERED, DUPLICATE_ID, DUPLICATE_ADDRESS. Heartbeats: UPDATED,
    RECONNECT (sent by the displaced id still listed), IGNORED. Losses:
    MARKED_UNKNOWN, NO_EFFECT. Further columns of the log are passed through.
    """
    kept = [*COLUMNS, *[name for name in log.columns if name not in COLUMNS]]
    log = log.select(*kept)
    ordinary, heavy = split_hot(log, "address", epoch_micros(log, "ts"), tie="seq")
    folded = (
        ordinary.filter(F.col("kind") != HEARTBEAT)
        .repartition("address")
        .sortWithinPartitions("address", "ts", "seq")
        .mapInArrow(_answered(["address"], kept, resumes=False), _output(log, kept))
    )
    beats = ordinary.filter(F.col("kind") == HEARTBEAT)
    columns = [*kept, "outcome", "replaced"]
    plain = _with_heartbeats(folded, beats, ["address"]).select(*columns)
    return plain.unionByName(_replay_hot(heavy, kept).select(*columns))


def replay_registry(log: DataFrame) -> DataFrame:
    """The rows still listed after :func:`replay`: ALIVE, UNKNOWN and DEAD ones.

    An address lists its latest accepted id, UNKNOWN if it was marked later, and the
    id that one displaced, DEAD, unless a newcomer was refused since. So at most two
    rows per kind of outcome matter, and Spark's group limit drops the others before
    the shuffle. Further columns are those of the accepted registration.
    """
    rest = [name for name in log.columns if name not in COLUMNS]
    wanted = [REGISTERED, MARKED_UNKNOWN, DUPLICATE_ADDRESS]
    newest = Window.partitionBy("address", "outcome").orderBy(F.desc("ts"), F.desc("seq"))
    at = F.struct("ts", "seq")
    row = F.struct("ts", "seq", "id", "replaced", *rest)

    def newest_at(outcome: str):
        return F.max(F.when((F.col("outcome") == outcome) & (F.col("nth") == 1), at))

    def accepted(nth: int):
        chosen = (F.col("outcome") == REGISTERED) & (F.col("nth") == nth)
        return F.max_by(F.when(chosen, row), F.when(chosen, at))

    per_address = (
        replay(log.filter(F.col("kind") != HEARTBEAT))
        .filter(F.col("outcome").isin(wanted))
        .withColumn("nth", F.row_number().over(newest))
        .filter(F.col("nth") <= 2)
        .groupBy("address")
        .agg(
            accepted(1).alias("owner"),
            accepted(2).alias("displaced"),
            newest_at(MARKED_UNKNOWN).alias("marked"),
            newest_at(DUPLICATE_ADDRESS).alias("refused"),
        )
    )
    owner_at = F.struct(F.col("owner.ts").alias("ts"), F.col("owner.seq").alias("seq"))
    marked = F.col("marked").isNotNull() & (F.col("marked") > owner_at)
    refused = F.col("refused").isNotNull() & (F.col("refused") > owner_at)
    listed = F.array(
        F.struct(
            F.when(marked, "UNKNOWN").otherwise("ALIVE").alias("state"),
            F.col("owner").alias("row"),
        ),
        F.struct(
            F.when(F.col("displaced").isNotNull() & ~refused, "DEAD").alias("state"),
            F.col("displaced").alias("row"),
        ),
    )
    return (
        per_address.filter(F.col("owner").isNotNull())
        .select("address", F.explode(listed).alias("listed"))
        .filter(F.col("listed.state").isNotNull())
        .select(
            "address",
            F.col("listed.row.id").alias("id"),
            F.col("listed.state").alias("state"),
            F.col("listed.row.ts").alias("accepted_at"),
            F.col("listed.row.seq").alias("accepted_seq"),
            *[F.col(f"listed.row.{name}").alias(name) for name in rest],
        )
    )
