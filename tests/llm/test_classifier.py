"""The rule ensemble on held-out rows, and its compiled form against the rules one by one."""

from __future__ import annotations

import math
import zlib

import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F

from rollcall.llm.classifier import STATISTICS, fitted, scored, with_statistics
from rollcall.llm.queries import op8_quality
from rollcall.sources import table

SCHEMA = "doc_id long, text string, score double, upper string"


def test_held_out_rows(spark):
    found = {r.doc_id: r for r in op8_quality(spark, MEDIUM).collect()}
    documents = [r.doc_id for r in table(spark, MEDIUM, "documents").collect()]
    assert sorted(found) == sorted(documents)
    for r in found.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    tested = [(r.quality, found[r.doc_id]) for r in table(spark, MEDIUM, "labels").collect() if found[r.doc_id].held_out]
    assert len(tested) > 50
    assert sum(q == f.predicted for q, f in tested) >= 0.95 * len(tested)
    good, bad = [f.score for q, f in tested if q], [f.score for q, f in tested if not q]
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_compiled_rules_equal_rules_one_by_one(spark):
    rows = with_statistics(table(spark, MEDIUM, "documents")).join(table(spark, MEDIUM, "labels"), "doc_id").cache()
    model = fitted(rows, "quality")
    assert 0 < len(model.rules) < 100
    for r in rows.withColumn("score", model.score()).collect():
        total = model.intercept + sum(rule.weight for rule in model.rules if rule.holds(r.asDict()))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))
    rows.unpersist()


def test_edges(spark):
    rows = [(1, None, 1.0, "x"), (2, "", 1.0, "x"), (3, "Ein Wort\n\nEIN 12! 𝒳", None, None), (None, "x", 1.0, "x"), (3, "w " * 20_000, 1.0, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    stats = with_statistics(frame).collect()
    assert all(v == 0 for r in stats[:2] for k, v in r.asDict().items() if k != "doc_id")
    third = stats[2].asDict()
    assert (third["n_words"], third["distinct_words"], third["line_words"], third["distinct_lines"]) == (5, 0.8, 2.5, 1.0)
    assert third["marks"] == pytest.approx(1 / 19) and third["upper"] == pytest.approx(6 / 19, abs=0.06)
    out = F.col("doc_id") == 2
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in scored(frame, none, out).collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0), (3, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    found = scored(frame, one, out).collect()
    assert all(r.score > 0.7 for r in found) and [r.held_out for r in found if r.doc_id is None] == [True]
    assert scored(frame.limit(0), one, out).count() == 0
    assert set(STATISTICS) <= set(with_statistics(frame).columns)
