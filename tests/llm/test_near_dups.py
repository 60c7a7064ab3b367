"""Near duplicates against every pair of sets."""

from __future__ import annotations

import random
import re

import pytest

from rollcall.llm import near_dups
from rollcall.llm.near_dups import deduplicated, near_duplicates

SCHEMA = "doc_id long, text string, component_id string, n_shingles int"


def shingle_set(text, length):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < length:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}


def brute(rows, length, percent):
    sets = [(r[0], shingle_set(r[1], length)) for r in rows]
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if None not in (a, b) and common and 100 * common >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return sorted((str(a), len(x), str(root(a))) for a, x in sets)


def found(spark, rows, length, percent):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    result = near_duplicates(frame, length, percent).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in result)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in result)


def test_edges(spark):
    rows = [(5, "A b C d e"), (3, "a B c  d\ne"), (9, None), (8, ""), (7, " \n"), (6, "one"), (4, "ONE"), (2, "one two"), (None, "a b c d e"),
            (5, "a b c d e"), (5, "other words are here too"), (11, "other words are here TOO"), (12, "É x y z " * 9000), (13, "É x y z " * 9000 + "end")]
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_families(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_SETS", 7)  # many blocks
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 8, 20, 60, 200]))]
        for _ in range(draw.choice([1, 2, 12])):
            # each copy is edited further, so groups are chains whose ends differ
            for _ in range(draw.choice([0, 1, 1, 2])):
                base[draw.randrange(len(base))] = draw.choice(vocabulary)
            rows.append((draw.randrange(10**6), " ".join(base)))
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g", "x", 1), (2, "A b c d e f g", "y", 2), (3, "q r s t u v w", "z", 3), (None, "a b c d e f g", None, None)]
    kept = deduplicated(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id", "n_shingles"]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "3", "None"]


def test_one_row_of_a_key_stays_and_names_may_clash(spark):
    text = " ".join(f"w{k}" for k in range(40))
    schema = "doc_id long, text string, dropped long, listed int, kept string"
    rows = [(1, text, 1, 1, "a"), (1, text, 1, 1, "a"), (1, text + " more", 2, 2, "b"), (2, text, 1, 1, "a"), (3, "other words", 3, 3, "c"), (3, "other words", 3, 3, "c")]
    rows += [(4, None, None, None, None), (4, None, None, None, None), (None, text, 0, 0, ""), (None, text, 0, 0, "")]
    frame = spark.createDataFrame(rows, schema).repartition(4)
    found = deduplicated(frame)
    assert found.schema == frame.schema
    assert sorted(str(r.doc_id) for r in found.collect()) == ["1", "3", "4", "None", "None"]
    assert deduplicated(spark.createDataFrame([], schema)).count() == 0


def test_long_lists_are_joined_by_a_shuffle(spark, monkeypatch):
    from conftest import SMALL

    from rollcall.llm import tables
    from rollcall.sources import table

    documents = table(spark, SMALL, "documents")
    few = sorted(r.doc_id for r in deduplicated(documents).collect())
    monkeypatch.setattr(tables, "SHORT_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r.doc_id for r in deduplicated(documents).collect()) == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
