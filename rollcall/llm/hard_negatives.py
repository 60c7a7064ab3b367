"""Hard-negative mining: cover trees over the candidates of each label, searched by blocks of anchors.

1. Vectors become integers, and candidates of one length and label are sorted by the signs of some fixed projections, so
   neighbours in that order point about the same way. Runs of at most ``CELL`` candidates are cells; each is one row of a table, with its
   cover tree (see ``cover_tree``). A label with a third of all rows has many cells, and copies of one vector are split by id.
2. Anchors of one length and label, in the same order, form blocks of at most ``BLOCK``. A block goes to the cells of
   its own label; the first ``positives`` candidates over all cells are the anchor's positives.
3. Each positive's score bounds a window of scores. A block with its windows goes to the cells of all other labels, where nodes outside
   the windows are skipped; of each window the first ``negatives`` over all cells are the result.

Blocks and cells meet by an exchange on (cell, group of blocks): a task reads a cell once and blocks one at a time, and no task holds
more than a cell, a block and what a block has found. What cells find is cut to the first few of each window before and after its own exchange.
Every anchor is compared with every cell it can have a partner in, at least with its root, so work grows with anchors x cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcall.llm.cover_tree import CoverTree, best, grown
from rollcall.llm.tables import stored

#: Candidates of a cell, anchors of a block, blocks that share a copy of a cell.
CELL, BLOCK, GROUP = 4096, 256, 256
#: Vectors as long as this, as integers, take no part: scores stay within 64 bits.
LONGEST = float(1 << 31)
#: Projections whose signs order vectors.
SIGNS = 24
#: So many partitions of the tables of cells and blocks at most, as one row of each is counted on the driver.
MOST_PARTS = 1 << 16
_ANY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Mining:
    """Integers are floor(scale * x); a negative has at least ``least`` percent of its positive's score and not more than it."""

    positives: int = 5
    negatives: int = 5
    scale: int = 256
    least: int = 80


def _projections(length: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((length, SIGNS))


def integer_vectors(frame: DataFrame, scale: int) -> DataFrame:
    """(name, label, vector, anchor) becomes (length, label, code, name, anchor, vector): a binary of little-endian 32-bit integers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            offsets = vectors.offsets.to_numpy()
            lengths, flat = np.diff(offsets), vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(scale * flat)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                values = whole[offsets[:-1][rows][:, None] + np.arange(length)]
                fits = np.sqrt((values * values).sum(axis=1)) < LONGEST
                rows, values = rows[fits], values[fits]
                signs = values @ _projections(length) > 0
                code = signs @ (1 << np.arange(SIGNS, dtype=np.int64))[::-1]
                packed = pa.array([x.tobytes() for x in values.astype("<i4")], pa.binary())
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), length), pa.int32()), batch.column(1).take(take), pa.array(code), batch.column(0).take(take), batch.column(3).take(take), packed],
                    names=["length", "label", "code", "name", "anchor", "vector"],
                )

    return frame.mapInArrow(convert, "length int, label long, code long, name long, anchor boolean, vector binary")


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Consecutive rows of one length and label, at most ``most`` at a time; columns 0 and 1 are sorted."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        rest = None
        kinds = np.column_stack([rows.column(k).to_numpy() for k in (0, 1)])
        edges = np.append(np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1, len(kinds))
        start = 0
        for edge in edges.tolist():
            while edge - start > most or (edge - start and edge < len(kinds)):
                stop = min(edge, start + most)
                yield rows.slice(start, stop - start)
                start = stop
        if start < len(kinds):
            rest = rows.slice(start).combine_chunks()
    if rest is not None:
        yield rest


def _matrix(packed: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<i4").reshape(-1, length) if length else np.zeros((len(packed), 0), np.int32)


def _numbered(frame: DataFrame, column: str) -> DataFrame:
    """``column`` as numbers from 0 without gaps in the order of (part, place); parts are at most MOST_PARTS."""
    counts = sorted(map(tuple, frame.groupBy("part").agg(F.count(F.lit(1))).collect()))
    ends = np.cumsum([n for _, n in counts])
    bases = [(part, int(end - n)) for (part, n), end in zip(counts, ends, strict=True)]
    bases = frame.sparkSession.createDataFrame(bases, "part int, base long")
    return frame.join(F.broadcast(bases), "part").withColumn(column, F.col("base") + F.col("place")).drop("part", "place", "base")


def _sorted_parts(rows: DataFrame, most: int) -> DataFrame:
    """Rows in ranges of (length, label, code, name), as many as fill some cells or blocks each."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, MOST_PARTS, -(-rows.count() // most)))
    order = ["length", "label", "code", "name"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def cells(rows: DataFrame) -> DataFrame:
    """(length, label, cell, ids, vectors, nodes): the cover tree of each cell, numbered in the order of length and label."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, run in enumerate(_runs(batches, CELL)):
            length, label = run.column(0)[0].as_py(), run.column(1)[0].as_py()
            tree = grown(run.column(3).to_numpy(), _matrix(run.column(4), length))
            row = [[length], [label], [part], [place], [tree.ids.astype("<i8").tobytes()], [tree.vectors.astype("<i4").tobytes()], [tree.nodes()]]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], names=["length", "label", "part", "place", "ids", "vectors", "nodes"])

    found = _sorted_parts(rows.drop("anchor"), CELL).mapInArrow(grow, "length int, label long, part int, place long, ids binary, vectors binary, nodes binary")
    return _numbered(stored(found, "cells"), "cell")


def blocks(rows: DataFrame) -> DataFrame:
    """(length, label, block, ids, vectors, low, high) of anchors (length, label, code, name, vector, low, high), numbered."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, run in enumerate(_runs(batches, BLOCK)):
            packed = [run.column(3).to_numpy().astype("<i8").tobytes(), b"".join(run.column(4).to_pylist())]
            packed += [np.array(run.column(k).to_pylist(), "<i8").tobytes() for k in (5, 6)]
            row = [[run.column(0)[0].as_py()], [run.column(1)[0].as_py()], [part], [place], *[[x] for x in packed]]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], names=["length", "label", "part", "place", "ids", "vectors", "low", "high"])

    rows = rows.select("length", "label", "code", "name", "vector", "low", "high")
    found = _sorted_parts(rows, BLOCK).mapInArrow(gather, "length int, label long, part int, place long, ids binary, vectors binary, low binary, high binary")
    return _numbered(stored(found, "blocks"), "block")


def searched(pairs: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(anchor, slot, found, score): the first ``k`` of each window of each anchor in each cell its block is paired with.

    ``pairs`` are blocks with a ``cell`` to search. Cells and blocks of one (cell, group) come together, the cell first.
    """
    group = F.floor(F.col("block") / GROUP).alias("group")
    none = F.lit(None).cast("binary")
    asked = pairs.select("cell", group, F.col("block").alias("at"), "length", "ids", "vectors", "low", "high")
    groups = asked.select("cell", "group").distinct()
    # Copies of a cell, one for each group of blocks; -1 sorts before all blocks.
    held = trees.join(groups, "cell").select("cell", "group", F.lit(-1).cast("long").alias("at"), "length", "ids", "vectors", F.col("nodes").alias("low"), none.alias("high"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tree = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                number, at, length, ids, vectors, low, high = (batch.column(c)[row].as_py() for c in (0, 2, 3, 4, 5, 6, 7))
                if at < 0:
                    cell, tree = number, CoverTree.restored(ids, vectors, low)
                    continue
                if number != cell:
                    raise ValueError(f"a block without its cell {number}")
                names = np.frombuffer(ids, "<i8")
                anchors = np.frombuffer(vectors, "<i4").reshape(len(names), length)
                windows = [np.frombuffer(x, "<i8").reshape(len(names), -1) for x in (low, high)]
                found = best(tree, anchors, names, *windows, k)
                if len(found):
                    columns = [names[found[:, 0]], found[:, 1], found[:, 3], found[:, 2]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["anchor", "slot", "found", "score"])

    both = held.unionByName(asked).repartition("cell", "group").sortWithinPartitions("cell", "group", "at")
    return both.mapInArrow(search, "anchor long, slot long, found long, score long")


def _first(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` of each group, with their rank; Spark cuts groups before the exchange too."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("found").asc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(embeddings: DataFrame, anchors: Column, rule: Mining = Mining(), key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all rows of which ``anchors`` is true.

    Rows with a null key, label, vector or component, or a component that is not finite, take no part, and neither do vectors whose
    integers are as long as ``LONGEST``. Rows of one key are one: that of the smallest label and vector. Vectors of different
    lengths are never compared. Scores that tie come by the smaller key. An anchor without positives, or a positive without a
    negative in its window, gives no rows. Keys are taken as long. Other columns are not read; an empty table gives no rows.
    """
    label = F.col(label) if isinstance(label, str) else label
    names = embeddings.select(F.col(key).cast("long").alias("name"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    names = names.where(F.col("name").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(sound)
    single = names.groupBy("name").agg(F.min(F.struct("label", "vector")).alias("of"), F.max("anchor").alias("anchor"))
    rows = stored(integer_vectors(single.select("name", "of.label", "of.vector", "anchor"), rule.scale), "vectors")
    trees = stored(cells(rows), "cover-trees")
    ranges = stored(trees.groupBy("length", "label").agg(F.min("cell").alias("first"), F.max("cell").alias("last")), "cell-ranges")
    of_length = ranges.groupBy("length").agg(F.min("first").alias("lowest"), F.max("last").alias("highest"))
    ranges = stored(ranges.join(of_length, "length"), "label-ranges")

    asked = rows.where("anchor").drop("anchor")
    everything = asked.withColumns({"low": F.array(F.lit(-_ANY)), "high": F.array(F.lit(_ANY))})
    own = blocks(everything).join(ranges, ["length", "label"]).withColumn("cell", F.explode(F.sequence("first", "last")))
    positives = stored(_first(searched(own, trees, rule.positives), rule.positives, "anchor").drop("slot"), "positives")

    # Windows by rank of the positive; one that is missing holds no score.
    scores = positives.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    score = lambda n: F.col("scores")[F.lit(n)]
    ranks = range(1, rule.positives + 1)
    lowest = lambda n: F.ceil(F.lit(rule.least) * score(n).cast("decimal(20,0)") / 100).cast("long")
    windows = asked.join(scores, asked["name"] == scores["anchor"]).drop("anchor")
    windows = windows.withColumns(
        {"low": F.array(*[F.coalesce(lowest(n), F.lit(1)).cast("long") for n in ranks]), "high": F.array(*[F.coalesce(score(n), F.lit(0)).cast("long") for n in ranks])}
    )
    span = lambda start, end: F.when(F.col(start) <= F.col(end), F.sequence(start, end)).otherwise(F.array().cast("array<long>"))
    around = ranges.withColumns({"before": F.col("first") - 1, "after": F.col("last") + 1})
    others = F.concat(span("lowest", "before"), span("after", "highest"))
    rest = blocks(windows).join(around, ["length", "label"]).withColumn("cell", F.explode(others))
    negatives = _first(searched(rest, trees, rule.negatives), rule.negatives, "anchor", "slot")
    found = negatives.select("anchor", (F.col("slot") + 1).cast("int").alias("of"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positives.select("anchor", F.col("rank").alias("of"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(of, ["anchor", "of"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
