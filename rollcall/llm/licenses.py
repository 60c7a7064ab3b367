r"""License scans: an exact set-similarity join of text blocks with license templates.

Words are lower-cased (A-Z) runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``. A block is a window of
``WINDOW`` words, one every ``STEP`` words of the whole text; a template is contained in a block when
at least ``threshold`` of its distinct words are. Template words are ordered by how often the whole
corpus has them, rarest first; with that order

* prefix filter: a block that contains a template has one of the template's first
  size - need + 1 words among its own first size - need + 1 template words;
* length filter: such a block has at least ``need`` template words;
* positional filter: where the two prefixes first meet, what follows on both sides must suffice.

The filters drop no match; what passes is confirmed on the whole sets. Words that are in no
template can't add to an overlap and are left out of the blocks' sets.

Base labels are phrases whose words stand one after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import words as W
from rollcall.llm.tables import stored

WINDOW, STEP = 96, 48

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str


# Openings of public license notices, of at most STEP words.
TEMPLATES = (
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited"),
    Template("all-rights-reserved", "All rights reserved"),
)


def _words(text: str) -> list[str]:
    words = W.split_words(pa.array([text], pa.large_string()), W.ALPHANUMERIC, W.LOWER)
    return [W.LOWER[np.frombuffer(words.word(i), np.uint8)].tobytes().decode() for i in range(len(words.starts))]


def _lookup(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words, and each one's place in the list."""
    hashes = np.array([W.hash_of(x) for x in vocabulary], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


def _places(hashes: np.ndarray, known: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where, which): words of the vocabulary among all words."""
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    where = np.flatnonzero(known[at] == hashes)
    return where, order[at[where]]


def word_counts(documents: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How often the whole corpus has each word of a (bounded) vocabulary."""
    known, order = _lookup(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, texts in W.slices(batch.column(0)):
                words = W.split_words(texts, W.ALPHANUMERIC, W.LOWER)
                total += np.bincount(_places(words.hashes, known, order)[1], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(total)], names=["word", "n"])

    counted = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word long, n long")
    found = {r.word: r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {word: found.get(at, 0) for at, word in enumerate(vocabulary)}


@dataclass(frozen=True)
class Plan:
    """Templates as ordered sets of word ranks."""

    vocabulary: list[str]
    labels: list[str]
    sets: list[list[int]]
    needs: list[int]

    @property
    def prefixes(self) -> list[list[int]]:
        return [s[: len(s) - need + 1] for s, need in zip(self.sets, self.needs, strict=True)]


def planned(documents: DataFrame, templates: tuple[Template, ...], threshold: float, text: str = "text") -> Plan:
    """Order the templates' words by their counts in the corpus, rarest first (ties by the word)."""
    words = [sorted(set(_words(t.text))) for t in templates]
    vocabulary = sorted({w for x in words for w in x})
    counts = word_counts(documents, vocabulary, text)
    vocabulary.sort(key=lambda w: (counts[w], w))
    rank = {w: at for at, w in enumerate(vocabulary)}
    sets = [sorted(rank[w] for w in x) for x in words]
    needs = [math.ceil(threshold * len(x) - 1e-9) for x in sets]
    return Plan(vocabulary, [t.label for t in templates], sets, needs)


def scanned(documents: DataFrame, plan: Plan, phrases: dict[str, str] = PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: counts, base labels, and blocks that hold a template's prefix word.

    Columns: row (unique), the key, n_words, n_base, first_word, last_word, base_labels,
    blocks (start, ranks in order).
    """
    known, order = _lookup(plan.vocabulary)
    heads = np.zeros(len(plan.vocabulary), bool)
    heads[[rank for x in plan.prefixes for rank in x]] = True
    least = min(plan.needs)
    runs = [(np.array([W.hash_of(w) for w in phrase.split()], np.uint64), label) for phrase, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                words, n = W.split_words(texts, W.ALPHANUMERIC, W.LOWER), len(texts)
                hits, labels = [], [set() for _ in range(n)]
                for run, label in runs:
                    at = np.flatnonzero(words.hashes[: max(len(words.hashes) - len(run) + 1, 0)] == run[0])
                    for k in range(1, len(run)):
                        at = at[words.hashes[at + k] == run[k]]
                    owner = np.searchsorted(words.bounds, at, "right") - 1
                    whole = at + len(run) <= words.bounds[owner + 1]
                    hits.append(at[whole])
                    for text_at in owner[whole]:
                        labels[text_at].add(label)
                hits = np.sort(np.concatenate(hits))
                low, high = np.searchsorted(hits, words.bounds[:-1]), np.searchsorted(hits, words.bounds[1:])
                counts = high - low
                firsts = [int(hits[a] - words.bounds[i]) if a < b else None for i, (a, b) in enumerate(zip(low, high, strict=True))]
                lasts = [int(hits[b - 1] - words.bounds[i]) if a < b else None for i, (a, b) in enumerate(zip(low, high, strict=True))]
                where, ranks = _places(words.hashes, known, order)
                blocks = [[] for _ in range(n)]
                head = where[heads[ranks]]
                owner = np.searchsorted(words.bounds, head, "right") - 1
                steps = (head - words.bounds[owner]) // STEP
                windows = np.unique(np.stack([np.tile(owner, 2), np.concatenate([steps, steps - 1])], axis=1), axis=0) if len(head) else np.zeros((0, 2), int)
                for text_at, step in windows[windows[:, 1] >= 0]:
                    start = words.bounds[text_at] + step * STEP
                    end = min(start + WINDOW, words.bounds[text_at + 1])
                    inside = np.unique(ranks[np.searchsorted(where, start) : np.searchsorted(where, end)])
                    if len(inside) >= least:
                        blocks[text_at].append({"start": int(step * STEP), "ranks": inside.tolist()})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0).slice(first, n),
                        pa.array(np.diff(words.bounds).astype(np.int64)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(firsts, pa.int64()),
                        pa.array(lasts, pa.int64()),
                        pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                        pa.array(blocks, pa.list_(pa.struct([("start", pa.int64()), ("ranks", pa.list_(pa.int32()))]))),
                    ],
                    names=["row", "key", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"],
                )
                row += n

    frame = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = dict(frame.dtypes)["key"]
    schema = f"row long, {key} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<start:bigint,ranks:array<int>>>"
    return frame.mapInArrow(scan, schema)


def contained(rows: DataFrame, plan: Plan) -> DataFrame:
    """(row, start, label, containment): every block of :func:`scanned` rows that contains a template."""
    spark = rows.sparkSession
    templates = [
        (at, label, len(s), need, s, rank, place)
        for at, (label, s, need) in enumerate(zip(plan.labels, plan.sets, plan.needs, strict=True))
        for place, rank in enumerate(s[: len(s) - need + 1])
    ]
    index = spark.createDataFrame(templates, "template int, label string, size int, need int, words array<int>, rank int, place int")
    blocks = rows.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("block"))
    blocks = blocks.select("row", "block.start", "block.ranks", F.posexplode("block.ranks").alias("at", "rank"))
    held = F.size("ranks")
    # The index has a row for each prefix word of a template, however large the corpus is.
    pairs = blocks.join(F.broadcast(index), "rank").where(
        (held >= F.col("need"))
        & (F.col("at") <= held - F.col("need"))
        & (F.least(F.col("size") - F.col("place"), held - F.col("at")) >= F.col("need"))
    )
    common = F.size(F.array_intersect("ranks", "words"))
    return pairs.select("row", "start", "template", "label", (common / F.col("size")).alias("containment"), (common >= F.col("need")).alias("good")).where("good").drop("good").distinct()


def licensed(
    documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.9, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Counts and labels of each document row.

    ``labels`` has the base labels and those of contained templates; ``score`` is 1 for a base label, else
    the largest containment, else 0. Null and empty texts have no words; nulls in ``key`` stay
    null; repeated rows get a row each; an empty table gives no rows; other columns are not read.
    """
    if max(len(_words(t.text)) for t in templates) > STEP:
        raise ValueError(f"templates have at most {STEP} words, so that a window holds them wherever they stand")
    plan = planned(documents, templates, threshold, text)
    rows = stored(scanned(documents, plan, phrases, key, text), "license-blocks")
    best = contained(rows, plan).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    return rows.join(best, "row", "left").select(
        key, "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
