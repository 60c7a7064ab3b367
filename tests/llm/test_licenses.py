"""License labels against every window and every template."""

from __future__ import annotations

import random
import re

from conftest import MEDIUM

from rollcall.llm.licenses import PHRASES, STEP, TEMPLATES, WINDOW, licensed
from rollcall.llm.queries import op5_licenses
from rollcall.sources import table

SCHEMA = "doc_id long, text string, label string, rank int"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    words, places, labels = words_of(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    best, more = 0.0, set(labels)
    for start in range(0, max(len(words), 1), STEP):
        block = set(words[start : start + WINDOW])
        for t in TEMPLATES:
            share = len(set(words_of(t.text)) & block) / len(set(words_of(t.text)))
            if share >= 0.9:
                best = max(best, share)
                more.add(t.label)
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(labels)), ",".join(sorted(more)), round(1.0 if places else best, 9)


def check(result, rows):
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in result)
    assert [list(map(str, x)) for x in got] == [list(map(str, x)) for x in sorted((str(k), *brute(t)) for k, t in rows)]


def test_whole_table(spark):
    result = op5_licenses(spark, MEDIUM).collect()
    check(result, [(r.doc_id, r.text) for r in table(spark, MEDIUM, "documents").collect()])
    assert {"mit", "apache-2", "cc-by-nc", "gpl-3", "all-rights-reserved"} <= {x for r in result for x in r.labels.split(",")}


def test_edges(spark):
    draw = random.Random(1)
    filler = ["the", "of", "licensed", "under", "software", "rights", "all", "é1", "Version", "2.0", "free", "x"]
    texts = [None, "", "CC-BY-NC", "under\nthe MIT-License! under the mit license", "cc by", "nc", "a " * 95 + "All rights a reserved"]
    for t in TEMPLATES:
        w = t.text.split()
        draw.shuffle(w)
        texts += [" ".join(w[: len(w) - 1]), " ".join(["x"] * draw.randrange(200) + w + ["x"] * 60), " ".join(" y ".join(w).split())]
    texts += [" ".join(draw.choice(filler) for _ in range(draw.randrange(300))) for _ in range(60)]
    texts.append(" ".join(draw.choice(filler) for _ in range(30_000)))
    rows = list(enumerate(texts)) + [(None, "All rights reserved.")] * 2
    check(licensed(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect(), rows)
    assert licensed(spark.createDataFrame([], SCHEMA)).count() == 0
