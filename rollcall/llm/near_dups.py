r"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped edges.

A document's set is its distinct shingles of words (runs of ``[^\x20\x09-\x0D]``, A-Z lower-cased);
with fewer words than a shingle has, the sequence of all; without words, empty.

1. Sets become classes (equal sets), so copies cost nothing from there on.
2. One permutation: a hash's top bits choose one of 128 bins and each bin keeps its
   smallest hash. An empty bin takes the value of the first full bin of its own fixed random
   sequence of bins (optimal densification). Four bins make one of 32 bands.
3. Classes that share a band are a bucket. Each member is linked to the bucket's smallest
   member only, so a bucket of m members has m - 1 candidate edges. Candidates are confirmed
   on full sets.
4. What a star can miss: two members that resemble each other and not the centre. Members connected
   over candidate edges are a cluster, which holds all pairs of each of its buckets. Clusters whose
   members are not all in one component after step 3 are joined exactly, in blocks of
   bounded size: pairs of different components that share a token of their prefixes (rarest first)
   are confirmed on full sets too.

With 32 bands of 4, a pair at similarity 0.8 shares no band once in 2 * 10**7 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import words as W
from rollcall.llm.graphs import components
from rollcall.llm.groups import whole_groups
from rollcall.llm.tables import kept, scratch, short, spare, stored

BINS, BAND = 128, 4
#: Sets and set elements in a block of a cluster.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 500_000
_BIN_SHIFT = np.uint64(64 - 7)


def _probes(count: int) -> np.ndarray:
    """count x BINS: the bins that each bin tries in turn, fixed for all documents."""
    steps = np.arange(count, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)
    return (W.mix(steps + np.uint64(0x5DEECE66D)) % np.uint64(BINS)).astype(np.int64)


def signature(unique: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The densified smallest hashes by bin of a sorted, non-empty array of distinct hashes."""
    bins = (unique >> _BIN_SHIFT).astype(np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[firsts]], full[bins[firsts]] = unique[firsts], True
    empty = np.flatnonzero(~full)
    if len(empty):
        rows = 16
        while len(empty):
            tried = probes[:rows, empty]
            hit = full[tried]
            found = hit.any(axis=0)
            if rows >= len(probes):
                found[:] = True  # after 4,096 tries: the first full bin, the same for all sets that come so far
                hit[0, ~hit.any(axis=0)] = True
            source = tried[hit.argmax(axis=0), np.arange(len(empty))]
            source = np.where(full[source], source, bins[0])
            values[empty[found]] = values[source[found]]
            empty, rows = empty[~found], rows * 4
    return values


def sketches(documents: DataFrame, length: int, key: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, digest_0, digest_1, bands) of each document row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probes(4096)
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                hashes, bounds = W.shingles(W.split_words(texts, W.NON_SPACE, W.LOWER), length)
                n = len(texts)
                sizes, digests = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
                values = np.zeros((n, BINS), np.uint64)
                for row in range(n):
                    unique = np.unique(hashes[bounds[row] : bounds[row + 1]])
                    if not len(unique):
                        continue
                    sizes[row] = len(unique)
                    mixed = W.mix(unique)
                    digests[row] = mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(W.mix(mixed + np.uint64(11)))
                    values[row] = signature(unique, probes)
                bands = np.repeat(np.arange(BINS // BAND, dtype=np.uint64)[None, :], n, axis=0)
                for k in range(BAND):
                    bands = W.mix(bands * np.uint64(31) + values[:, k::BAND])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(sizes),
                        pa.array(digests[:, 0].view(np.int64)),
                        pa.array(digests[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (BINS // BAND)), pa.array(bands.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "n_shingles", "digest_0", "digest_1", "bands"],
                )

    frame = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return frame.mapInArrow(sketch, "doc_id long, n_shingles long, digest_0 long, digest_1 long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets.

    ``texts`` (doc_id, text) is stored. Pairs with one centre ``b`` come one after another, so its set is
    built once for a run of them.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_known = None, None
        for batch in batches:
            for first, members in W.slices(batch.column(2)):
                hashes, bounds = W.shingles(W.split_words(members, W.NON_SPACE, W.LOWER), length)
                n, good = len(members), []
                for row in range(n):
                    centre = batch.column(3)[first + row]
                    if known is None or centre != known:
                        known = centre
                        centre_text = pa.array([centre.as_py() or ""], pa.large_string())
                        of_known = np.unique(W.shingles(W.split_words(centre_text, W.NON_SPACE, W.LOWER), length)[0])
                    own = np.unique(hashes[bounds[row] : bounds[row + 1]])
                    common = len(np.intersect1d(own, of_known, assume_unique=True))
                    good.append(bool(common) and 100 * common >= percent * (len(own) + len(of_known) - common))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, n).filter(keep) for k in (0, 1)], names=["a", "b"])

    by_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    by_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(by_a, "a").join(by_b, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(confirm, "a long, b long")


def _needed(documents: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text) of the documents in the pairs."""
    nodes = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(texts.join(stored(nodes, "pair-nodes"), "doc_id", "left_semi").distinct(), "pair-texts")


def exact_pairs(sets: list[np.ndarray], parts: np.ndarray, blocks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of sets of different parts at the similarity or above.

    Tokens are ordered by how many of the sets have them, rarest first. Two sets at the
    similarity share a token of the first size - ceil(share * size) + 1 of each. With two
    blocks, only pairs across them are looked at.
    """
    sizes = np.array([len(x) for x in sets])
    tokens, ranks, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(tokens), np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(len(tokens))
    owners = np.repeat(np.arange(len(sets)), sizes)
    ranks = order[ranks]
    place = np.lexsort((ranks, owners))
    within = np.arange(len(ranks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - (-(-percent * sizes // 100)) + 1
    kept = place[within < np.repeat(prefix, sizes)]
    heads, heads_of = ranks[kept], owners[kept]
    starts = np.searchsorted(heads_of, np.arange(len(sets) + 1))
    by_token = np.argsort(heads, kind="stable")
    sorted_heads, sorted_owners = heads[by_token], heads_of[by_token]
    holders = owners[np.argsort(ranks, kind="stable")]
    first_holder = np.searchsorted(np.sort(ranks), np.arange(len(tokens) + 1))
    firsts = np.cumsum(sizes) - sizes
    values, part_counts = np.unique(parts, return_counts=True)
    largest, two = values[part_counts.argmax()], len(np.unique(blocks)) > 1
    found = []
    for i in np.flatnonzero(parts != largest):
        own = heads[starts[i] : starts[i + 1]]
        low, high = np.searchsorted(sorted_heads, own, "left"), np.searchsorted(sorted_heads, own, "right")
        near = np.unique(np.concatenate([sorted_owners[x:y] for x, y in zip(low, high, strict=True)]))
        near = near[(parts[near] != parts[i]) & ((parts[near] == largest) | (near > i))]
        if two:
            near = near[blocks[near] != blocks[i]]
        small, big = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
        near = near[100 * small >= percent * big]
        if not len(near):
            continue
        # What the whole set has in common with every other, from the holders of its tokens.
        own = ranks[firsts[i] : firsts[i] + sizes[i]]
        low, many = first_holder[own], first_holder[own + 1] - first_holder[own]
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(holders[at], minlength=len(sets))[near]
        found += [(i, j) for j in near[100 * common >= percent * (sizes[i] + sizes[near] - common)].tolist()]
    return found


def _joined_cells(cells: DataFrame, length: int, percent: int) -> DataFrame:
    """Links (a, b) between components, from sorted rows (cluster, low, high, doc_id, component, own, text)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, 3):
            left, right = [], []
            parts, blocks = rows.column(4).to_numpy(), rows.column(5).to_numpy()
            for start, end in zip(bounds, np.append(bounds[1:], rows.num_rows), strict=True):
                if end - start < 2 or (parts[start:end] == parts[start]).all():
                    continue
                sets = []
                for _, texts in W.slices(rows.column(6).slice(start, end - start)):
                    hashes, at = W.shingles(W.split_words(texts, W.NON_SPACE, W.LOWER), length)
                    sets += [np.unique(hashes[at[k] : at[k + 1]]) for k in range(len(texts))]
                for i, j in exact_pairs(sets, parts[start:end], blocks[start:end], percent):
                    left.append(parts[start + i])
                    right.append(parts[start + j])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right)], names=["a", "b"])

    return cells.mapInArrow(join, "a long, b long")


def _grouped(documents: DataFrame, length: int, percent: int, key: str, text: str) -> DataFrame:
    """The rows of :func:`near_duplicates`, still to be computed from stored tables."""
    rows = stored(sketches(documents, length, key, text), "sketches")
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = stored(
        named.groupBy("digest_0", "digest_1").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")),
        "classes",
    )
    members = classes.select(F.explode("bands").alias("bucket"), "node")
    centres = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last")
    stars = members.join(stored(centres.select("bucket", "centre"), "centres"), "bucket").where("node <> centre")
    stars = stored(stars.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "stars")
    texts = _needed(documents, stars, key, text)
    links = confirmed(stars, texts, length, percent)
    # One id in several classes joins them.
    several = named.groupBy("doc_id").agg(F.count_distinct("digest_0", "digest_1").alias("n")).where("n > 1").select("doc_id")
    own = named.join(several, "doc_id", "left_semi").join(classes.select("digest_0", "digest_1", "node"), ["digest_0", "digest_1"])
    first = stored(components(links.union(own.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))), "components")
    clusters = components(stars).select("node", F.col("component").alias("cluster"))
    sizes = classes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    held = clusters.join(first, "node", "left").join(sizes, "node").select("cluster", "node", F.coalesce("component", "node").alias("component"), "n_shingles")
    held = stored(held, "clusters")
    mixed = held.groupBy("cluster").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = stored(mixed.where("low <> high").select("cluster", blocks.alias("blocks")), "mixed-clusters")
    cells = (
        held.join(mixed, "cluster")
        .join(texts.withColumnRenamed("doc_id", "node"), "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "component", "own", "text")
    )
    cells = cells.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    more = components(_joined_cells(cells, length, percent).distinct()).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    parts = first.join(more, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    lone = more.join(first.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("merged").alias("component"))
    parts = stored(parts.union(lone), "node-components")
    final = classes.select("digest_0", "digest_1", "node").join(parts, "node", "left")
    final = stored(final.select("digest_0", "digest_1", F.coalesce("component", "node").alias("component_id")), "class-components")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    found = rows.select("doc_id", "n_shingles", "digest_0", "digest_1").join(final, ["digest_0", "digest_1"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def near_duplicates(documents: DataFrame, length: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents``.

    ``component_id`` is the smallest id reachable over links, ``kept`` whether it is the row's own.
    Null or wordless texts have an empty set and are linked with nothing. A null id is linked with nothing
    either and kept. Rows with one id are one node: links of any of them count, and equal rows get equal
    results. Ids are compared as long. Other columns are not read; an empty table gives no rows.
    """
    with scratch(documents.sparkSession):
        return kept(_grouped(documents, length, percent, key, text), "near-duplicates")


def deduplicated(documents: DataFrame, length: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which :func:`near_duplicates` keeps one for each group, with all their columns.

    Of rows that repeat a key one stays, whatever their other columns hold. Rows with a null key, and with null, empty or
    wordless texts, have no group and all stay but for repeated keys. Columns of any name pass through; an empty table gives no rows.
    """
    spark, name = documents.sparkSession, spare(documents, "listed")
    ids = F.col(key).cast("long")
    with scratch(spark):
        rows = near_duplicates(documents, length, percent, key, text)
        dropped = kept(rows.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "dropped")
        repeated = kept(rows.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name), "repeated")
    left = documents.join(short(dropped), ids == F.col(name), "left_anti")
    if repeated.isEmpty():
        return left
    repeated = short(repeated)
    first = left.join(repeated, ids == F.col(name), "left_semi").dropDuplicates([key])
    return left.join(repeated, ids == F.col(name), "left_anti").unionByName(first)
