"""Who owns an address: the per-message rule, and the effect of a stretch of messages.

The state of an address is ``(owner, lost, dead)``: the id that owns it, whether
that owner was reported lost, and the displaced id that is still listed as dead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from rollcall.sources.fleet_log import HEARTBEAT, LOST, REGISTER

REGISTERED = "REGISTERED"
DUPLICATE_ID = "DUPLICATE_ID"
DUPLICATE_ADDRESS = "DUPLICATE_ADDRESS"
UPDATED = "UPDATED"
RECONNECT = "RECONNECT"
IGNORED = "IGNORED"
MARKED_UNKNOWN = "MARKED_UNKNOWN"
NO_EFFECT = "NO_EFFECT"

State = tuple[str | None, bool, str | None]
NO_OWNER: State = (None, False, None)


def answer(state: State, kind: str, sender: str) -> tuple[str, State]:
    """Outcome of one message and the state after it."""
    owner, lost, dead = state
    if kind == HEARTBEAT:
        if sender == owner:
            return UPDATED, state
        return (RECONNECT if sender == dead else IGNORED), state
    if kind == LOST:
        if sender == owner:
            return MARKED_UNKNOWN, (owner, True, dead)
        return NO_EFFECT, state
    if sender == owner:
        return DUPLICATE_ID, state
    # A newcomer clears the dead entry even if it is then refused.
    if owner is None:
        return REGISTERED, (sender, False, None)
    if lost:
        return REGISTERED, (sender, False, owner)
    return DUPLICATE_ADDRESS, (owner, False, None)


# How a stretch of messages maps the state before it to the state after it.
#
# It cannot be run before the state is known, but few starts need telling apart:
# no owner; an owner reported lost within the stretch; an owner already lost before
# it, who is or is not the first to register; any other owner. Each start is
# followed as one thread, and threads that reach the same owner run on as one.

NONE = "none"
ALIVE = "alive"
UNKNOWN = "unknown"

# Where the dead entry after the stretch comes from.
DEAD_NONE = "none"
DEAD_KEPT = "kept"
DEAD_WAS_OWNER = "owner"
DEAD_IS = "id"

# (start, start_owner or None for any other, owner or None for unchanged, lost,
#  dead_from, dead_id, sole_registrant)
Effect = tuple[str, str | None, str | None, bool, str, str | None, str | None]


def effects(messages: Iterable[tuple[str, str]]) -> Iterator[Effect]:
    """Effects of one stretch, given as ``(kind, id)`` in order.

    Always yields the effect on "any other living owner", so that every stretch has
    a row. A start that has no effect listed passes through unchanged. Each message
    costs amortised constant time.
    """
    # Owner -> threads. A thread is (start, start_owner, dead_from, dead_id, since);
    # a merged thread is (None, None, DEAD_IS, dead_id, since, threads).
    living: dict[str, list] = {}
    missing: dict[str, list] = {}
    split: set[str] = set()
    latest = None  # id of the latest registration
    latest_at = other_at = -1  # its place, and the last place of any other id

    for place, (kind, sender) in enumerate(messages):
        if kind == LOST:
            moved = living.pop(sender, [])
            if sender not in split:
                split.add(sender)
                moved.append((ALIVE, sender, DEAD_KEPT, None, -1))
            if moved:
                missing.setdefault(sender, []).extend(moved)
        elif kind == REGISTER:
            taken = living.setdefault(sender, [])
            if latest is None:
                taken.append((NONE, None, DEAD_NONE, None, place))
                taken.append((UNKNOWN, None, DEAD_WAS_OWNER, None, place))
                missing.setdefault(sender, []).append((UNKNOWN, sender, DEAD_KEPT, None, -1))
            for owner in [name for name in missing if name != sender]:
                taken.append((None, None, DEAD_IS, owner, place, missing.pop(owner)))
            if sender != latest:
                latest, other_at = sender, latest_at
            latest_at = place

    for lost, owners in ((False, living), (True, missing)):
        for owner, threads in owners.items():
            newcomer_at = other_at if owner == latest else latest_at
            for thread in threads:
                cleared = newcomer_at > thread[4]
                dead_from, dead_id = (DEAD_NONE, None) if cleared else thread[2:4]
                open_threads = [thread]
                while open_threads:
                    at = open_threads.pop()
                    if len(at) == 6:
                        open_threads.extend(at[5])
                    else:
                        yield at[0], at[1], owner, lost, dead_from, dead_id, None

    if latest is None:
        yield ALIVE, None, None, False, DEAD_KEPT, None, None
    elif other_at >= 0:
        yield ALIVE, None, None, False, DEAD_NONE, None, None
    else:
        yield ALIVE, None, None, False, DEAD_NONE, None, latest


Table = dict[tuple[str, str | None], Effect]


def _dead_after(dead_from: str, dead_id: str | None, owner: str, then: Effect) -> tuple[str, str | None]:
    """The dead entry of a start that a first stretch leaves with ``owner``, after a second stretch."""
    if then[2] is None:
        kept = then[4] == DEAD_KEPT or then[6] == owner
        return (dead_from, dead_id) if kept else (DEAD_NONE, None)
    if then[4] == DEAD_KEPT:
        return dead_from, dead_id
    return (DEAD_IS, owner) if then[4] == DEAD_WAS_OWNER else (then[4], then[5])


def compose(first: Table, then: Table) -> Table:
    """The effects of two stretches in a row, as if they were one; an empty table has no effect.

    It is associative, so stretches can be composed in any grouping. A start has one row at most, whatever the
    number of stretches.
    """
    if not first or not then:
        return then or first
    both: Table = {}
    any_other, any_later = first[ALIVE, None], then[ALIVE, None]
    for start, effect in first.items():
        owner, lost, dead_from, dead_id = effect[2:6]
        if owner is None:
            continue
        now = UNKNOWN if lost else ALIVE
        later = then.get((now, owner)) or then.get((now, None))
        if later is not None:
            dead_from, dead_id = _dead_after(dead_from, dead_id, owner, later)
            owner, lost = (owner, False) if later[2] is None else later[2:4]
        both[start] = (*start, owner, lost, dead_from, dead_id, None)
    for (start, owner), effect in then.items():
        if start != ALIVE:
            # The first stretch passes these on if it has no row for any of their kind.
            if (start, None) not in first:
                both[start, owner] = effect
        elif owner is not None and (start, owner) not in first:
            kept = any_other[4] == DEAD_KEPT or any_other[6] == owner
            dead_from, dead_id = _dead_after(DEAD_KEPT if kept else DEAD_NONE, None, owner, effect)
            both[start, owner] = (start, owner, *effect[2:4], dead_from, dead_id, None)
    soles = {effect[6] for effect in (any_other, any_later) if effect[4] != DEAD_KEPT}
    sole = soles.pop() if len(soles) == 1 else None
    kept = any_other[4] == any_later[4] == DEAD_KEPT
    both[ALIVE, None] = (ALIVE, None, None, False, DEAD_KEPT if kept else DEAD_NONE, None, sole)
    return both


def apply_effects(state: State, table: dict[tuple[str, str | None], Effect]) -> State:
    """The state after a stretch, given its effects by ``(start, start_owner)``."""
    owner, _, dead = state
    start = NONE if owner is None else UNKNOWN if state[1] else ALIVE
    effect = table.get((start, owner)) or table.get((start, None))
    if effect is None:
        return state
    _, _, new_owner, lost, dead_from, dead_id, sole = effect
    if new_owner is None:
        # Unchanged owner; only its own registrations leave the dead entry alone.
        kept = dead_from == DEAD_KEPT or (sole is not None and sole == owner)
        return owner, False, dead if kept else None
    choices = {DEAD_NONE: None, DEAD_KEPT: dead, DEAD_WAS_OWNER: owner, DEAD_IS: dead_id}
    return new_owner, lost, choices[dead_from]
