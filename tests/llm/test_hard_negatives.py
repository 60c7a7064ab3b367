"""Cover trees and mined negatives against every pair."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import cover_tree, hard_negatives
from rollcall.llm.cover_tree import CoverTree, best, grown

ANY = np.iinfo(np.int64).max


def every_pair(ids, vectors, anchors, names, low, high, k):
    scores, out = anchors.astype(object) @ vectors.astype(object).T, []
    for a in range(len(anchors)):
        for w in range(low.shape[1]):
            near = [(-scores[a, j], ids[j]) for j in range(len(ids)) if ids[j] != names[a] and low[a, w] <= scores[a, j] <= high[a, w]]
            out += [(a, w, -score, name) for score, name in sorted(near)[:k]]
    return out


def families(rng, kind, n):
    if kind == "groups":
        return rng.normal(size=(20, 16))[rng.integers(20, size=n)] * 300 + rng.normal(size=(n, 16)) * 6
    if kind == "spread":
        return rng.normal(size=(n, 16)) * 100
    if kind == "copies":
        return np.repeat(rng.normal(size=(1, 8)) * 100, n, axis=0)
    if kind == "zeros":
        return np.zeros((n, 4))
    if kind == "ties":
        return rng.integers(-2, 3, size=(n, 3))
    return rng.normal(size=(n, 8)) * 10.0 ** rng.uniform(0, 8, size=(n, 1))  # norms from 1 to 10**8


@pytest.mark.parametrize("kind", ["groups", "spread", "copies", "zeros", "ties", "norms"])
@pytest.mark.parametrize("n", [1, 2, 65, 900])
def test_search_equals_every_pair(kind, n):
    rng = np.random.default_rng(n)
    vectors, ids = np.floor(families(rng, kind, n)).astype(np.int64), rng.permutation(3 * n)[:n]
    tree = grown(ids, vectors)
    tree = CoverTree.restored(tree.ids.tobytes(), tree.vectors.tobytes(), tree.nodes())
    m = min(n, 15)
    anchors, names = np.concatenate([vectors[:m], 0 * vectors[:1], -vectors[:1]]), np.append(ids[:m], [-1, -2])
    low, high = np.full((len(anchors), 1), -ANY), np.full((len(anchors), 1), ANY)
    assert [tuple(x) for x in best(tree, anchors, names, low, high, 5).tolist()] == every_pair(ids, vectors, anchors, names, low, high, 5)
    top = (anchors @ vectors.T).max(axis=1)
    high = np.stack([top // 2, top - 1, np.abs(top) // 9, -np.abs(top)], axis=1)
    low = -(-80 * high // 100)
    assert [tuple(x) for x in best(tree, anchors, names, low, high, 3).tolist()] == every_pair(ids, vectors, anchors, names, low, high, 3)


def test_nodes_cover_and_are_apart():
    rng = np.random.default_rng(4)
    vectors = np.floor(families(rng, "groups", 1500)).astype(np.int64)
    tree = grown(np.arange(1500), vectors)
    points = cover_tree._sphere(tree.vectors)
    top = tree.radius[0]
    assert len(tree.centre) > 20 and sorted(tree.ids) == list(range(1500))
    for node in range(len(tree.centre)):
        span = slice(tree.first[node], tree.last[node])
        assert cover_tree._angles(points[span], points[tree.centre[node]]).max() <= tree.radius[node] + 1e-9
        children = np.flatnonzero(tree.parent == node)
        if len(children):
            level = tree.level[children[0]]
            assert (tree.level[children] == level).all() and level > tree.level[node]
            centres = points[tree.centre[children]]
            apart = [cover_tree._angles(centres[k + 1 :], centres[k]) for k in range(len(children))]
            assert all((x > tree.radius[children].max() - 1e-9).all() for x in apart if len(x))
            assert sum(tree.last[children] - tree.first[children]) == tree.last[node] - tree.first[node]


def test_most_leaves_are_skipped_where_vectors_are_grouped():
    rng = np.random.default_rng(5)
    vectors = np.floor(families(rng, "groups", 4000)).astype(np.int64)
    tree, visited = grown(np.arange(4000), vectors), []
    any_score = np.full((50, 1), ANY)
    best(tree, vectors[:50], np.arange(50), -any_score, any_score, 5, visited)
    assert len(visited) < 0.3 * 50 * tree.leaf.sum()


def mined_plainly(rows, scale=256):
    single = {}
    for name, label, vector, anchor in rows:
        if name is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(scale * x) for x in vector]
        if math.sqrt(sum(x * x for x in whole)) < 2**31:
            single.setdefault(name, []).append((label, vector, whole, anchor))
    single = {name: min(held, key=lambda x: x[:2]) for name, held in single.items()}
    out = []
    for name, (label, _, whole, anchor) in single.items():
        if not anchor:
            continue
        others = [(-sum(x * y for x, y in zip(whole, v, strict=True)), n, other) for n, (other, _, v, _) in single.items() if n != name and len(v) == len(whole)]
        for score, positive, _ in sorted(x for x in others if x[2] == label)[:5]:
            near = sorted(x[:2] for x in others if x[2] != label and 80 * -score <= 100 * -x[0] <= 100 * -score)[:5]
            out += [(name, positive, rank, n, -score, -s) for rank, (s, n) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("cell, block", [(4096, 256), (7, 3)])
def test_mining_equals_every_pair(spark, monkeypatch, cell, block):
    monkeypatch.setattr(hard_negatives, "CELL", cell)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", 2)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 6))
    rows = [(k, int(rng.choice([0, 0, 0, 1, 2, -3])), (centres[k % 4] + rng.normal(size=6) * 0.3).round(3).tolist(), k % 5 == 0) for k in range(300)]
    rows += [(1000 + k, k % 3, [0.5, 0.25, 0.0, -0.5, 0.1, 1.0], k % 5 == 0) for k in range(40)]  # one vector
    rows += [(2000 + k, 1 + k % 2, [1.0, float(k)], True) for k in range(12)]  # another length
    rows += [rows[5], rows[5], (rows[5][0], 9, [0.0] * 6, False)]  # repeated, and one id with two vectors
    rows += [(None, 1, [1.0] * 6, True), (3000, None, [1.0] * 6, True), (3005, 1, None, True), (3010, 1, [1.0, None], True), (3015, 1, [math.nan] * 6, True), (3020, 1, [math.inf] * 6, True)]
    rows += [(3025, 0, [1e9] * 6, True), (3030, 0, [], True), (3035, 0, [], False), (3040, 1, [], False), (3045, 0, [0.0] * 6, True), (3050, 1, [5e6, 0.0, 0.0, 0.0, 0.0, 0.0], True)]
    schema = "vec_id long, label int, embedding array<double>, is_anchor boolean, score string, `rank` int, cell string"
    frame = spark.createDataFrame([(*r, "x", 1, None) for r in rows], schema).repartition(3)
    found = hard_negatives.mined(frame, F.col("is_anchor"))
    assert sorted(map(tuple, found.collect())) == mined_plainly(rows)
    assert hard_negatives.mined(spark.createDataFrame([], schema), F.col("is_anchor")).count() == 0
