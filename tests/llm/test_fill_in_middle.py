"""Cuts against a plain walk over tokens, exact restoration, and long and hostile texts."""

from __future__ import annotations

import hashlib
import re

import pytest
from conftest import MEDIUM
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollcall.llm.fill_in_middle import Rule, TokenEnds, fill_in_middle, restored, transformed
from rollcall.llm.queries import op11_fill_in_middle
from rollcall.sources import table

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(key, text, rule=Rule()):
    units = TOKENS.findall(text or "")
    text, n = "".join(units), len(units)
    digest = hashlib.sha256(f"{rule.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rule.rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if h[3] % 100 < rule.spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab <>PSM\t\n\x0b 　é😀", max_size=40), st.integers(0, 10**6))
def test_one_match_finds_all_tokens(text, key):
    ends_of = TokenEnds()
    ends = [m.end() for m in TOKENS.finditer(text)]
    assert ends_of(text) == ends
    assert all(ends_of(text, piece) == ends for piece in (1, 2, 5))
    rule = Rule(rate=100, spm=50)
    assert transformed(text, key, rule, ends_of) == expected(key, text, rule)


def test_whole_table(spark):
    rows = {r.doc_id: r for r in op11_fill_in_middle(spark, MEDIUM).collect()}
    documents = table(spark, MEDIUM, "documents").collect()
    assert len(rows) == len(documents)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for d in documents:
        n, form, prefix, middle, output = expected(d.doc_id, d.text)
        assert tuple(rows[d.doc_id])[1:] == (n, form, prefix, middle, sha(output), sha(d.text or ""))
    assert {r.form for r in rows.values()} == {"plain", "spm", "psm"}


def test_edges(spark):
    texts = ["", None, " ", "<P>x", "a<M", "S>b c", "word " * 400_000, " " * 3_000_000, "x" * 2_000_000, "same", "same", "a b", "<", "<S<P <M"]
    schema = "doc_id long, text string, n string, output int, key string"
    rows = [(k if k != 9 else 10, t, "n", 1, "k") for k, t in enumerate(texts)] + [(None, "no key here", None, None, None)]
    found = fill_in_middle(spark.createDataFrame(rows, schema), Rule(rate=100))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = found.withColumn("whole", restored(F.col("output"), F.col("form"))).collect()
    ends = sorted((str(r.doc_id), r.whole) for r in back)
    assert ends == sorted((str(r[0]), r[1] or "") for r in rows)
    for r in back:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.whole, Rule(rate=100))
    assert fill_in_middle(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("rate", [0, 100])
def test_rates(spark, rate):
    forms = {r.form for r in fill_in_middle(table(spark, MEDIUM, "documents").where("n_chars > 0"), Rule(rate=rate, spm=0)).select("form").distinct().collect()}
    assert forms <= ({"plain"} if not rate else {"plain", "psm"})
