"""Repeated passages: planted ones, chains against all chains, and every exact repeat by brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from conftest import MEDIUM

from rollcall.llm.queries import op10_substring_dups
from rollcall.llm.substring_dups import COST, K, SPAN, Limits, chains, minimizers, repeated_passages
from rollcall.sources import table

SCHEMA = "doc_id long, text string, place int, seed string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_minimizers():
    draw = np.random.default_rng(2)
    hashes = draw.integers(0, 50, 400).astype(np.uint64)
    bounds = np.array([0, 0, 5, 5 + SPAN, 150, 151, 400])
    places, owner = minimizers(hashes, bounds)
    expected = set()
    for low, high in zip(bounds, bounds[1:]):
        for start in range(low, max(high - SPAN, low) + 1):
            window = hashes[start : min(start + SPAN, high)]
            if len(window):
                expected.add(start + len(window) - 1 - int(window[::-1].argmin()))
    assert set(places.tolist()) == expected
    assert all(bounds[o] <= p < bounds[o + 1] for p, o in zip(places, owner))


@pytest.mark.parametrize("seed", range(30))
def test_best_chain(seed):
    draw = random.Random(seed)
    runs = [(draw.randrange(60), draw.randrange(60), draw.randrange(3, 15)) for _ in range(8)]

    def score(chain):
        total = 0
        for at, (a, b, n) in enumerate(chain):
            total += n
            if at:
                x, y, m = chain[at - 1]
                if x + m > a or y + m > b:
                    return -1
                total -= COST * (a - x - m + b - y - m)
        return total

    best = max(score(c) for size in range(1, 9) for c in combinations(sorted(runs), size))
    assert max(score(c) for c in chains(runs, 1000)) == best


@pytest.mark.parametrize("seed", range(30))
def test_best_chain_within_the_gap(seed):
    draw, gap = random.Random(seed), 12
    runs = sorted({(draw.randrange(70), draw.randrange(70), draw.randrange(3, 15)) for _ in range(11)})

    def score(chain):
        total = chain[0][2]
        for (x, y, m), (a, b, n) in zip(chain, chain[1:]):
            own, other = a - x - m, b - y - m
            if not (0 <= own <= gap and 0 <= other <= gap):
                return -1
            total += n - COST * (own + other)
        return total

    best = max(score(c) for size in range(1, 7) for c in combinations(runs, size))
    found = chains(runs, gap)
    assert max(map(score, found)) == best and min(map(score, found)) > 0
    assert sorted(r for c in found for r in c) == runs


def test_two_passages_far_apart_in_the_other(spark):
    assert sorted(chains([(0, 0, 500), (500, 1500, 30), (531, 1531, 30)], 48)) == [[(0, 0, 500)], [(500, 1500, 30), (531, 1531, 30)]]
    draw = random.Random(6)
    some = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    first, left, right = some(500), some(30), some(30)
    other = [*first, *some(1000), *left, "one", *right, *some(50)]
    own = [*some(50), *first, "between", *left, "two", *right, *some(50)]
    rows = [(1, " ".join(other), 1, "x"), (2, " ".join(own), 1, "x")]
    found = {(r.first_word, r.end_word, r.other_first_word, r.other_end_word) for r in repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(50, 550, 0, 500), (551, 612, 1500, 1561)}


def test_exact_repeats_of_whole_table(spark):
    texts = {r.doc_id: words_of(r.text) for r in table(spark, MEDIUM, "documents").collect()}
    found = op10_substring_dups(spark, MEDIUM).collect()
    covered = {}
    for r in found:
        own, other = texts[r.doc_id][r.first_word : r.end_word], texts[r.other_id][r.other_first_word : r.other_end_word]
        assert r.passage_end - r.passage_first >= 40 and r.passage_first <= r.first_word < r.end_word <= r.passage_end
        assert min(len(own), len(other)) >= K + SPAN - 1 and r.agreeing_words >= 0.8 * max(len(own), len(other)) and r.other_id < r.doc_id
        covered.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
        covered.setdefault(r.other_id, set()).update(range(r.other_first_word, r.other_end_word))
    first = {}
    repeats = 0
    for key in sorted(texts):
        words = texts[key]
        for i in range(len(words) - 49):
            run = tuple(words[i : i + 50])
            if first.setdefault(run, key) != key:
                repeats += 1
                assert set(range(i, i + 50)) <= covered.get(key, set()), (key, i, first[run])
    assert repeats


def test_edited_passages_and_edges(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    passage, rows = some(120), []
    for k in range(30):
        edited = list(passage)
        for at in (30, 61, 95):
            edited[at : at + draw.randrange(2)] = some(draw.randrange(1, 3))
        rows.append((k, " ".join(some(50 + k) + (edited if k else passage) + some(40)).upper(), 1, "x"))
    whole = " ".join(some(60))
    rows += [(100, whole, 1, "x"), (102, whole, 1, "x"), (101, whole, 1, "x"), (103, " ".join(some(300)), 1, "x"), (104, None, 1, "x"), (105, "", 1, "x"), (106, "a b", 1, "x"),
             (107, "a b", 1, "x"), (None, whole, 1, "x"), (103, " ".join(some(300)), 1, None), (100, whole, 1, "x"), (108, "z " * 30_000, 1, "x")]
    found = repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: r for r in found}
    assert sorted(by) == [*range(1, 30), 101, 102] and len({(r.doc_id, r.passage_first) for r in found}) == len(by)
    for k in range(1, 30):
        assert 0 in {r.other_id for r in found if r.doc_id == k} and abs(by[k].passage_first - 50 - k) <= 2 and 110 <= by[k].passage_end - by[k].passage_first <= 130
    assert (by[101].other_id, by[102].other_id, by[101].end_word) == (100, 100, 60)
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert K + SPAN - 1 < Limits().words
