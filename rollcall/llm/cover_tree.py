"""A cover tree over integer vectors for search by inner product, within one bounded cell of candidates.

Candidates get one more coordinate, so that all have the norm of the longest: on that sphere an inner product with an
anchor (whose added coordinate is 0) falls with the angle between them, and angles are a metric. A node of a level has
a centre, one of the candidates, and the centres of its children are a net of the level's radius: each candidate of the node is
within that radius of a child's centre, and the centres are further than it from each other. Radii shrink by ``BASE`` from one level
to the next. Each node also keeps its covering radius, the largest angle from its centre to a candidate under it.
A node is a leaf if it has few candidates or all in one place, or if its net would have hardly fewer points than it has.

With angle t from an anchor to a centre and covering radius r, inner products of the node's candidates lie between those at angles
t + r and t - r. A search keeps nodes whose range meets a window of scores that is still open, from level to level, and takes each
anchor's leaves best first: the first one, then twice as many each round, while the worst score kept rises. What is in a leaf is scored exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Ratio of radii of successive levels, candidates of a leaf, and the least mean of candidates of a net's points.
BASE, LEAF, MEAN = 1.3, 64, 16
#: Double precision holds integers exactly below.
EXACT = float(1 << 53)
#: Angles and bounds are widened by this share, far over the error of double precision.
SLACK = 1e-7


@dataclass
class CoverTree:
    """Candidates in an order in which every node's are consecutive, and the nodes level by level."""

    ids: np.ndarray  # long, by candidate
    vectors: np.ndarray  # int32, candidates x dimension
    centre: np.ndarray  # by node: place of the candidate
    radius: np.ndarray
    level: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray

    _FIELDS = (("centre", np.int32), ("radius", np.float64), ("level", np.int32), ("parent", np.int32), ("first", np.int32), ("last", np.int32), ("leaf", np.int8))

    def nodes(self) -> bytes:
        return b"".join(np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self._FIELDS)

    @classmethod
    def restored(cls, ids: bytes, vectors: bytes, nodes: bytes) -> CoverTree:
        held, row, at = np.frombuffer(ids, np.int64), sum(np.dtype(kind).itemsize for _, kind in cls._FIELDS), 0
        count, fields = len(nodes) // row, []
        for _, kind in cls._FIELDS:
            fields.append(np.frombuffer(nodes, kind, count, at))
            at += fields[-1].nbytes
        return cls(held, np.frombuffer(vectors, np.int32).reshape(len(held), -1), *fields)

    def __post_init__(self) -> None:
        wide = self.vectors.astype(np.float64)
        self.norm = float(np.sqrt((wide * wide).sum(axis=1).max(initial=0.0)))
        self.wide = wide


def _sphere(vectors: np.ndarray) -> np.ndarray:
    """The vectors with the coordinate that makes their norms equal, as unit vectors; zeros if all are zero."""
    wide = vectors.astype(np.float64)
    squares = (wide * wide).sum(axis=1)
    most = squares.max(initial=0.0)
    return np.column_stack([wide, np.sqrt(np.maximum(most - squares, 0.0))]) / np.sqrt(most or 1.0)


def _angles(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles of unit vectors, from chords: exact near 0."""
    return 2 * np.arcsin(np.minimum(np.linalg.norm(points - centre, axis=1) / 2, 1.0))


def _net(points: np.ndarray, places: np.ndarray, angles: np.ndarray, radius: float, most: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Candidates dealt to the points of a net: (places, angles), centre first. None beyond ``most`` points.

    The first point is the node's own centre; the next ones are candidates that none covers yet.
    """
    parts, near = [], angles <= radius
    parts.append((places[near], angles[near]))
    left = places[~near]
    while len(left):
        if len(parts) == most:
            return None
        found = _angles(points[left], points[left[0]])
        near = found <= radius
        near[0] = True
        parts.append((left[near], found[near]))
        left = left[~near]
    return parts


def grown(ids: np.ndarray, vectors: np.ndarray) -> CoverTree:
    """The tree of some candidates, at least one."""
    points = _sphere(vectors)
    start = np.arange(len(ids))
    angles = _angles(points, points[0])
    angles[0] = 0.0
    order: list[np.ndarray] = []
    nodes: list[list] = []  # centre, radius, level, parent, places; later levels come after
    waiting = [(start, angles, 0, -1)]
    top = float(angles.max())
    while waiting:
        after = []
        for places, from_centre, level, parent in waiting:
            number, radius, parts = len(nodes), float(from_centre.max()), None
            if len(places) > LEAF and radius > SLACK:
                # The first level of which the net has two points.
                step = max(1, int(np.floor(np.log(top / radius) / np.log(BASE))) + 1)
                parts = _net(points, places, from_centre, min(top * BASE**-step, radius * (1 - SLACK)), max(2, len(places) // MEAN))
                level_of = step
            nodes.append([int(places[0]), radius, level, parent, places if parts is None else None])
            for own, own_angles in parts or ():
                after.append((own, own_angles, max(level_of, level + 1), number))
        waiting = after
    # Candidates in the order of a walk through the tree: children of a node are consecutive in theirs.
    children: list[list[int]] = [[] for _ in nodes]
    for number, node in enumerate(nodes):
        if node[3] >= 0:
            children[node[3]].append(number)
    first, last, at, stack = np.zeros(len(nodes), np.int32), np.zeros(len(nodes), np.int32), 0, [(0, False)]
    while stack:
        number, left = stack.pop()
        if left:
            last[number] = at
            continue
        first[number] = at
        stack.append((number, True))
        if nodes[number][4] is not None:
            order.append(nodes[number][4])
            at += len(nodes[number][4])
        stack += [(child, False) for child in reversed(children[number])]
    walk = np.concatenate(order)
    place = np.empty(len(walk), np.int32)
    place[walk] = np.arange(len(walk), dtype=np.int32)
    columns = list(zip(*nodes, strict=True))
    return CoverTree(
        ids[walk], vectors[walk].astype(np.int32), place[np.array(columns[0])], np.array(columns[1]), np.array(columns[2], np.int32),
        np.array(columns[3], np.int32), first, last, np.array([x is not None for x in columns[4]], np.int8),
    )


def _scores(anchors: np.ndarray, candidates: np.ndarray, safe: bool) -> np.ndarray:
    """Exact inner products of integer vectors held as doubles."""
    if safe:
        return (anchors @ candidates.T).astype(np.int64)
    return anchors.astype(np.int64) @ candidates.astype(np.int64).T


def _kept(found: np.ndarray, k: int) -> np.ndarray:
    """Of rows (anchor, window, score, id) the first k of each anchor and window: higher scores, then smaller ids."""
    found = found[np.lexsort((found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
    change = np.ones(len(found), bool)
    change[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    starts = np.flatnonzero(change)
    rank = np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found))))
    return found[rank < k]


def best(tree: CoverTree, anchors: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, visited: list | None = None) -> np.ndarray:
    """Rows (anchor, window, score, id): the first k candidates of each anchor with a score within each of its windows.

    ``low`` and ``high`` are anchors x windows, both included; a candidate with the anchor's own name is left out.
    ``visited``, if given, gets (anchor, leaf) pairs scored.
    """
    anchors, low, high = anchors.astype(np.float64), low.astype(np.int64), high.astype(np.int64)
    lengths = np.sqrt((anchors * anchors).sum(axis=1))
    reach = lengths * tree.norm
    safe = bool((reach < EXACT).all())
    count = len(anchors)
    above, below = np.zeros((count, len(tree.centre))), np.zeros((count, len(tree.centre)))
    live = np.zeros((count, len(tree.centre)), bool)
    floor = low.copy()

    def open_nodes(upper: np.ndarray, lower: np.ndarray, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        found = np.zeros(upper.shape, bool)
        for w in range(low.shape[1]):
            ends = (low[rows, w] <= high[rows, w])[:, None]
            found |= ends & (upper >= floor[rows, w][:, None]) & (lower <= high[rows, w][:, None])
        return found

    depth = np.zeros(len(tree.parent), np.int32)
    for node in range(1, len(depth)):
        depth[node] = depth[tree.parent[node]] + 1
    for step in range(int(depth.max(initial=0)) + 1):
        nodes = np.flatnonzero(depth == step)
        if step:
            nodes = nodes[live[:, tree.parent[nodes]].any(axis=0)]
        if not len(nodes):
            break
        cosine = np.clip((anchors @ tree.wide[tree.centre[nodes]].T) / np.maximum(reach, 1e-300)[:, None], -1.0, 1.0)
        angle, radius = np.arccos(cosine), tree.radius[nodes] + SLACK
        margin = reach[:, None] * SLACK + 1e-3
        above[:, nodes] = reach[:, None] * np.cos(np.maximum(angle - radius, 0.0)) + margin
        below[:, nodes] = reach[:, None] * np.cos(np.minimum(angle + radius, np.pi)) - margin
        live[:, nodes] = open_nodes(above[:, nodes], below[:, nodes])
        if step:
            live[:, nodes] &= live[:, tree.parent[nodes]]
    leaves = np.flatnonzero(tree.leaf)
    leaves = leaves[live[:, leaves].any(axis=0)]
    found = np.zeros((0, 4), np.int64)
    if not len(leaves):
        return found
    upper, lower, todo = above[:, leaves], below[:, leaves], live[:, leaves].copy()
    sequence = np.argsort(-np.where(todo, upper, -np.inf), axis=1, kind="stable")
    rank = np.empty_like(sequence)
    np.put_along_axis(rank, sequence, np.broadcast_to(np.arange(len(leaves)), sequence.shape), axis=1)
    start, width = 0, 1
    while start < len(leaves):
        turn = todo & (rank >= start) & (rank < start + width) & open_nodes(upper, lower)
        fresh = [found]
        for leaf in np.flatnonzero(turn.any(axis=0)):
            rows = np.flatnonzero(turn[:, leaf])
            span = slice(tree.first[leaves[leaf]], tree.last[leaves[leaf]])
            scores = _scores(anchors[rows], tree.wide[span], safe)
            others = tree.ids[span][None, :] != names[rows][:, None]
            if visited is not None:
                visited += [(int(row), int(leaves[leaf])) for row in rows]
            for w in range(low.shape[1]):
                at, place = np.nonzero(others & (scores <= high[rows, w][:, None]) & (scores >= floor[rows, w][:, None]))
                fresh.append(np.column_stack([rows[at], np.full(len(at), w), scores[at, place], tree.ids[span][place]]))
        found = _kept(np.concatenate(fresh), k)
        full = np.zeros(low.shape, np.int64)
        np.add.at(full, (found[:, 0], found[:, 1]), 1)
        worst = np.full(low.shape, np.iinfo(np.int64).max)
        np.minimum.at(worst, (found[:, 0], found[:, 1]), found[:, 2])
        floor = np.where(full >= k, np.maximum(floor, worst), floor)
        start, width = start + width, width * 2
    return found
