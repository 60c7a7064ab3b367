"""Each stage of the pipeline on what the one before it kept, against brute force."""

from __future__ import annotations

import hashlib
import importlib
import re
from collections import Counter, defaultdict

import pytest
from conftest import SMALL
from test_decontamination import longest
from test_decontamination import words_of as plain_words
from test_near_dups import brute as brute_groups
from test_packing import whole_ids
from test_pii import base
from test_quality_rules import measures

from rollcall.sources import table

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into the first stage and comes out of each."""
    found = [table(spark, SMALL, "documents")]
    for _, stage in pipeline.STAGES:
        out = stage(spark, found[-1], SMALL)
        found.append(spark.createDataFrame(out.collect(), out.schema))
    return [f.collect() for f in found]


def normal(line):
    line = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line)).strip(" ")


def body(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or [" ".join(words)]
    return min(hashlib.md5(run.encode()).hexdigest() for run in runs)


def test_names():
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "personal data", "packing"]


def test_quality(stages):
    before, after = stages[0], {r.doc_id: r for r in stages[1]}
    having, of_host = defaultdict(set), defaultdict(set)
    for r in before:
        of_host[r.source].add(body(r.text))
        for line in r.text.split("\n"):
            if measures(line)[0]:
                having[r.source, normal(line)].add(body(r.text))
    expected = {}
    for r in before:
        n, _, _, _, repeated = measures(r.text)
        lines = r.text.split("\n")
        cut = [len(having[r.source, normal(x)]) >= max(5, 0.01 * len(of_host[r.source])) for x in lines]
        left = n - sum(measures(x)[0] for x, c in zip(lines, cut, strict=True) if c)
        if n >= 10 and 100 * repeated <= 20 * n and left >= 5 and left >= 0.3 * n:
            expected[r.doc_id] = "\n".join(x for x, c in zip(lines, cut, strict=True) if not c)
    assert {k: r.text for k, r in after.items()} == expected
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_duplicates(stages):
    groups = brute_groups([(r.doc_id, r.text) for r in stages[1]], 5, 80)
    assert sorted(str(r.doc_id) for r in stages[2]) == sorted(key for key, _, group in groups if key == group)


def test_decontamination(spark, stages):
    items = [plain_words(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    kept = {r.doc_id for r in stages[3]}
    for r in stages[2]:
        words = plain_words(r.text)
        whole = any(f" {' '.join(i)} " in f" {' '.join(words)} " for i in items)
        assert not (whole and r.doc_id in kept)
        if r.doc_id not in kept:
            assert whole or any(longest(i, words) >= 0.6 * len(i) for i in items)


def test_personal_data(stages):
    after = {r.doc_id: r for r in stages[4]}
    assert [r.doc_id for r in stages[3]] and set(after) == {r.doc_id for r in stages[3]}
    for r in stages[3]:
        text = after[r.doc_id].text
        assert not base(text) and after[r.doc_id].n_chars == len(text)
        if not base(r.text):
            assert text == r.text
        else:
            assert any(sign in text for sign in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]"))


def test_packing(stages):
    ids = dict(zip((r.doc_id for r in stages[4]), whole_ids([r.text for r in stages[4]]), strict=True))
    got = defaultdict(list)
    for r in sorted(stages[5], key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got[r.doc_id])
        got[r.doc_id] += r.ids
    assert got == ids
    assert max(Counter({s: sum(r.length for r in stages[5] if r.sequence_id == s) for s in {r.sequence_id for r in stages[5]}}).values()) <= 2048


def test_run_gives_the_last_stage(spark, stages):
    rows = pipeline.run(spark, SMALL).collect()
    # Where documents are cut follows from how they fall into partitions; their ids do not.
    whole = [defaultdict(list), defaultdict(list)]
    for part, found in zip(whole, (rows, stages[5]), strict=True):
        for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
            part[r.doc_id] += r.ids
    assert whole[0] == whole[1]
