"""Leaks against word-by-word search: exact passages, edited ones, and clean texts."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import MEDIUM

from rollcall.llm.decontamination import MARGIN, Known, Limits, Search, Terms, _sums, common_words, decontaminated, leaks, queries_of
from rollcall.llm.queries import op1_decontamination
from rollcall.llm.words import ALPHANUMERIC, LOWER, split_words
from rollcall.sources import table

SCHEMA = "doc_id long, text string, item_id string, cosine int"
ITEMS = "item_id long, text string, doc_id int"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_common_words():
    draw = random.Random(3)
    for _ in range(50):
        a, b = ([draw.randrange(8) for _ in range(draw.randrange(1, 90))] for _ in range(2))
        masks = {}
        for bit, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << bit
        assert common_words(masks, len(a), b) == longest(a, b)


def test_whole_tables(spark):
    items = {r.item_id: words_of(r.text) for r in table(spark, MEDIUM, "benchmark").collect()}
    texts = {r.doc_id: words_of(r.text) for r in table(spark, MEDIUM, "documents").collect()}
    whole = {k: f" {' '.join(w)} " for k, w in texts.items()}
    exact = {(k, i) for k, t in whole.items() for i, w in items.items() if f" {' '.join(w)} " in t}
    found = op1_decontamination(spark, MEDIUM).collect()
    assert exact and exact <= {(r.doc_id, r.item_id) for r in found} and len(found) == len({(r.doc_id, r.item_id) for r in found})
    for r in found:
        common = longest(items[r.item_id], texts[r.doc_id][r.first_word : r.end_word])
        assert (common, len(items[r.item_id])) == (r.common_words, r.item_words) and common >= 0.6 * r.item_words


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.choice([2, 3, 6]))) for _ in range(3000)]
    sentence = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, f"{sentence(draw.randrange(12, 50))}. {sentence(5)}.", 1) for i in range(40)]
    items += [(40, sentence(400), 1), (41, None, 1), (42, "", 1), (None, sentence(30), 1), (7, items[7][1], 1)]
    rows, planted = [], set()
    for k in range(400):
        text = sentence(draw.randrange(1, 300))
        if k % 4 == 0:
            item, words = k // 4 % 40, None
            words = items[item][1].split()
            for _ in range(len(words) // 10):  # a paraphrase: a tenth of the words change
                words[draw.randrange(len(words) - 6)] = draw.choice(vocabulary)
            text = f"{text} {' '.join(words).upper()} {sentence(draw.randrange(100))}"
            planted.add((k, item))
        rows.append((k, text, "x", 1))
    rows += [(400, None, "x", 1), (401, "", "x", 1), (None, items[3][1], "x", 1), (0, rows[0][1], "x", 1), (402, sentence(30_000) + " " + items[40][1], None, None)]
    return rows, items, planted | {(402, 40), (None, 3)}


def test_planted_paraphrases(spark, corpus):
    rows, items, planted = corpus
    documents, benchmark = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS)
    found = leaks(documents, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    assert sum((r.doc_id, r.item_id) == (0, 0) for r in found) == 2
    kept = decontaminated(documents, benchmark)
    assert kept.columns == documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] is None or r[0] not in {k for k, _ in planted})


def test_short_tails_and_short_items(spark):
    spelled = lambda n: [f"item{n}word{k}" for k in range(n)]
    items = [(n, " ".join(spelled(n)), 1) for n in (1, 2, 3, 5, 129, 130, 136, 257)]
    assert all(len(q.words) >= 64 for q in queries_of([i[:2] for i in items[4:]]))
    assert [w for q in queries_of([items[7][:2]]) for w in q.words] == list(queries_of([(0, " ".join(spelled(257)[:128]))])[0].words) + [
        w for part in (spelled(257)[128:256], spelled(257)[256:]) for w in queries_of([(0, " ".join(part))])[0].words
    ]
    plain = [f"plain{k}" for k in range(60)]
    rows = [(n, " ".join(plain + spelled(n)[-m:] + plain), "x", 1) for n, m in ((1, 1), (2, 2), (129, 1), (130, 2), (136, 8), (257, 1))]
    rows += [(1000 + n, " ".join(plain + spelled(n) + plain), "x", 1) for n in (3, 5, 129, 257)]
    rows += [(2003, " ".join([*plain, *spelled(3)[:2], "and", spelled(3)[2], *plain]), "x", 1), (2005, " ".join(plain + spelled(5)[:4]), "x", 1), (2001, "item1word0", "x", 1)]
    found = leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1003, 3), (1005, 5), (1129, 129), (1257, 257), (2001, 1)}


def test_exact_passages_of_few_terms():
    """Two words of its own among a hundred that all items have: the cosine is near sqrt(T/W), under the general limit."""
    draw = random.Random(5)
    common = [f"common{k}" for k in range(100)]
    items = [(i, " ".join([*draw.sample(common, 50), f"own{i}a", *draw.sample(common, 50), f"own{i}b"])) for i in range(60)]
    queries = queries_of(items)
    terms = Terms(queries)
    search = Search(queries, terms, np.eye(len(terms.known), dtype=np.float32), Limits())
    for i, text in items:
        # other items' terms around it, so that its own are a small part of each window
        others = " ".join(f"own{draw.randrange(60)}a" for _ in range(40))
        words = split_words(pa.array(["x y", f"{others} {text} {others}"], pa.large_string()), ALPHANUMERIC, LOWER)
        assert (1, i, 102) in {(r[0], r[1], r[4]) for r in search.leaks(words)}


def test_known_words_of_crowded_slots():
    draw = random.Random(2)
    known = {0, 1, 2, 5, (1 << 64) - 1, (1 << 64) - 3, *(draw.getrandbits(64) for _ in range(100)), *(7 << 50 | k for k in range(0, 40, 2))}
    hashes = [*known, 3, 4, (1 << 64) - 2, *(draw.getrandbits(64) for _ in range(500)), *(7 << 50 | k for k in range(60))]
    draw.shuffle(hashes)
    where, which = Known(known).of(np.array(hashes, np.uint64))
    assert where.tolist() == [k for k, x in enumerate(hashes) if x in known] and [sorted(known)[k] for k in which] == [hashes[k] for k in where]
    assert not len(Known(set()).of(np.array([5, 1 << 63], np.uint64))[0]) and not len(Known(known).of(np.zeros(0, np.uint64))[0])


@pytest.mark.parametrize("sizes", [[], [1], [3, 0, 1, 0, 0, 2], [200, 1, 8, 9, 0, 7], [70, 90], [0, 8, 8]])
def test_sums_by_group(sizes):
    draw = np.random.default_rng(4)
    table, groups = draw.integers(-99, 99, (50, 7)).astype(np.float32), np.repeat(np.arange(len(sizes)), sizes)
    rows = draw.integers(0, 50, len(groups))
    expected = np.array([table[rows[groups == k]].sum(axis=0) for k in range(len(sizes) + 2)])
    assert np.array_equal(_sums(table, rows, groups, len(sizes) + 2), expected)
    fractions = draw.standard_normal((50, 7)).astype(np.float32)
    found = _sums(fractions, rows, groups, len(sizes) + 2)
    for k in set(groups.tolist()):  # no other rounding, either
        assert np.array_equal(found[k], np.add.reduceat(fractions[rows[groups == k]], [0], axis=0)[0])


def test_candidates_have_words_enough():
    """Two terms of an item give a window cosine and terms enough, but without the item's common words no leak is possible."""
    draw = random.Random(6)
    common, filler = [f"common{k}" for k in range(150)], [f"filler{k}" for k in range(500)]
    items = [(i, " ".join([*draw.sample(common, draw.randrange(10, 60)), *draw.choices(common[:5], k=6), f"own{i}a", f"own{i}b"])) for i in range(70)]
    texts = ["", "own3a"]
    for k in range(300):
        words = items[k % 70][1].split()
        part = [w if draw.random() < k % 11 / 10 else draw.choice(filler) for w in words[:-2]] + words[-2:]
        texts.append(" ".join([*draw.choices(filler, k=draw.randrange(40)), *part, *draw.choices(common + filler, k=draw.randrange(90))]))
    queries = queries_of(items)
    terms = Terms(queries)
    search = Search(queries, terms, np.eye(len(terms.known), dtype=np.float32), Limits())
    assert len(search.bits) > 1  # common words in more than one integer
    words = split_words(pa.array(texts, pa.large_string()), ALPHANUMERIC, LOWER)
    found, leaking = set(search.candidates(words)), list(search.leaks(words))
    search.repeated = search.repeated + 10_000  # so many words are counted that none is left out
    everything = list(search.candidates(words))
    able = set()
    for text, start, span, number, cosine in everything:
        whole = words.hashes[words.bounds[text] : words.bounds[text + 1]].tolist()
        window = set(whole[max(start - MARGIN, 0) : start + span + MARGIN])
        if sum(w in window for w in queries[number].words) >= 0.6 * len(queries[number].words):
            able.add((text, start, span, number, cosine))
    assert able and able <= found <= set(everything) and len(found) < 2 * len(able) < len(everything)
    assert leaking == list(search.leaks(words)) and {k + 2 for k in range(300) if k % 11 == 10} <= {r[0] for r in leaking}


def test_empty_tables(spark, corpus):
    documents, benchmark = spark.createDataFrame(corpus[0][:5], SCHEMA), spark.createDataFrame(corpus[1], ITEMS)
    assert leaks(documents.limit(0), benchmark).count() == 0
    assert leaks(documents, benchmark.limit(0)).count() == 0
    assert queries_of([(1, "A b x. C d e!\nF g")])[0].answer == queries_of([(1, "c d e")])[0].words


def test_clashing_names_repeated_keys_and_empty_tables(spark):
    item = "the quick brown fox jumps over the lazy dog near the quiet river bank at dawn"
    schema = "doc_id long, text string, _leaking int, leaking string, _text string"
    rows = [(1, f"before {item} after", 1, "x", None), (1, "another row of the same key", 1, "x", None), (2, "nothing of that", 1, "x", None), (None, item, 1, "x", None), (3, None, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    benchmark = spark.createDataFrame([(7, item, "z")], "item_id long, text string, leaking string")
    found = decontaminated(frame, benchmark)
    assert found.schema == frame.schema and sorted(str(r.doc_id) for r in found.collect()) == ["2", "3", "None"]
    assert decontaminated(frame, benchmark.limit(0)).count() == 5
    assert decontaminated(frame.limit(0), benchmark).count() == 0
