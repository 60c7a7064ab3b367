"""Personal data against plain patterns and counts, one text at a time."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import MEDIUM

from rollcall.llm.pii import REACH, digest, found, sanitised
from rollcall.llm.queries import op4_pii
from rollcall.sources import table

SCHEMA = "doc_id long, text string, spans string, n_chars int"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end(), m[0]) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]


def lower(word):
    return re.sub("[A-Z]", lambda m: m[0].lower(), word)


def brute(rows):
    """All spans of each row."""
    spans = [base(t or "") for _, t in rows]
    letters = r"[^\W\d_]+"
    n_t, n_e, n_et, texts, near = Counter(), Counter(), Counter(), defaultdict(set), []
    for (_, text), held in zip(rows, spans, strict=True):
        text, around = text or "", []
        for kind, start, end, value in held:
            left, right = max(0, start - REACH), min(len(text), end + REACH)
            for low, high, cut_low, cut_high in ((left, start, left > 0, False), (end, right, False, right < len(text))):
                for m in re.finditer(letters, text[low:high]):
                    a, b = low + m.start(), low + m.end()
                    edge = (cut_low and a == low) or (cut_high and b == high)
                    if not edge and not any(o[1] < b and a < o[2] for o in held):
                        around.append(((kind, value), lower(m[0]), a, b))
        near.append(around)
        n_t.update({lower(w) for w in re.findall(letters, text)})
        n_e.update({(h[0], h[3]) for h in held})
        for pair in {x[:2] for x in around}:
            n_et[pair] += 1
            texts[pair].add(text)
    good = set()
    for (entity, term), n in n_et.items():
        information = math.log2(len(rows) / n_e[entity])
        shared = math.log2(n * len(rows) / (n_e[entity] * n_t[term]))
        if len(texts[entity, term]) >= 2 and information > 0 and shared >= 0.8 * information:
            good.add((entity, term))
    out = []
    for held, around in zip(spans, near, strict=True):
        terms = sorted({("term", a, b) for e, t, a, b in around if (e, t) in good})
        out.append(([h[:3] for h in held], terms))
    return out


def write(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def compare(result, rows):
    expected = Counter()
    for (key, _), (held, terms) in zip(rows, brute(rows), strict=True):
        counts = tuple(sum(h[0] == k for h in held) for k in PLAIN)
        expected[(key, *counts, hashlib.sha256(write(held).encode()).hexdigest(), write(held + terms))] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in result) == expected
    return expected


def test_whole_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, MEDIUM, "documents").collect()]
    compare(op4_pii(spark, MEDIUM).collect(), rows)


EDGES = [
    None, "", "a@b.c_d@e.f x@y", "a.b@c-d.e.f.g, <q%+@1.2>", "999.1.2.3 1.2.3.4.5.6.7.8 0001.02.255.256 00255.1.1.1 1.2.3", "4242 4242 4242 4242-4 4242-4242-4242-4242",
    "+1 (212) 555-0153 +4 +12 +1.2.3.4.5.6.7.8.9.0(1 ++123456789", "4111111111111111" * 3, "5 5 5", "x" * 5000 + "@" + "y" * 5000, "7" * 3000, "été 𝒳 ü@a.b İ me@x.yz 𝒳",
]


def test_edges(spark):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(None, "me@x.org"), (None, "me@x.org")]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    compare(digest(found(frame)).collect(), rows)
    assert found(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_disclosing_terms(spark, seed):
    draw = random.Random(seed)
    common, rows = [f"{a}{b}" for a in "abcdefgh" for b in "xyzw"], []
    for i in range(120):
        words = [draw.choice(common) for _ in range(draw.randrange(3, 40))]
        if i % 6 == 0:
            words[1:1] = ["Zorgan", f"p{i % 4}@x.org", "quilte", "10.0.0.7"]
        rows.append((i, " ".join(words)))
    rows += rows[:7]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    expected = compare(digest(found(frame)).collect(), rows)
    assert any("term" in x[-1] for x in expected)
    clean = {r.doc_id: r for r in sanitised(frame).collect()}
    assert "@" not in clean[0].text and "[EMAIL]" in clean[0].text and "[NAME]" in clean[0].text and "quilte" not in clean[0].text
    assert clean[1].text == rows[1][1] and clean[0].n_chars == len(clean[0].text) and sanitised(frame).columns == frame.columns


def test_overlapping_spans_are_replaced_once(spark):
    frame = spark.createDataFrame([(1, "call +4222222222222 now a@1.2.3.4 end", "s", 1)], SCHEMA)
    assert sanitised(frame).first().text == "call [PHONE] now [EMAIL] end"


def test_sanitised_empty_tables_and_clashing_names(spark):
    schema = "doc_id long, text string, print_0 string, all_spans int, spans string, n_chars long"
    frame = spark.createDataFrame([(1, "write to a@b.example now", "p", 1, "s", 24), (None, None, None, None, None, None), (2, "", "", 0, "", 0)], schema)
    found = sanitised(frame)
    assert found.schema == frame.schema
    assert sorted((str(r.text), r.n_chars) for r in found.collect() if r.n_chars is not None) == [("", 0), ("write to [EMAIL] now", 20)]
    assert sanitised(spark.createDataFrame([], schema)).count() == 0
