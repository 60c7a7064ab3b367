r"""Passages that repeat across documents, exactly or with edits: seeds, collinear chains, alignment.

Words are runs of ``[^\x20\x09-\x0D]``, A-Z lower-cased.

1. Seeds: of every ``SPAN`` consecutive runs of ``K`` words the one with the smallest hash
   (a minimizer). Two texts that share SPAN + K - 1 = 23 words in a row share a seed. Copies of
   whole texts are found by their hash and have no other part in what follows: the smallest id with a text stands for it.
2. Each seed is joined with its first place in the corpus (smallest document, then position), so a seed
   that m documents share makes m - 1 hits, never all pairs.
3. The hits of a document with one other are chained: a tree over positions in the other
   document finds, for each run of hits, the best chain that ends before it and within the longest gap of it in
   both, where a gap costs by its length.
4. Chains are aligned word by word: outwards from the hits while words agree, and between them by
   the longest common subsequence of the gap; gaps that disagree too much end a part. A part has at least K + SPAN - 1 words of
   which at least ``share`` agree.
5. Parts of one document that overlap or touch, be they from different documents, are a
   passage, which has at least ``words`` words: its seeds may have come first in different places.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm import words as W
from rollcall.llm.decontamination import common_words
from rollcall.llm.groups import whole_groups
from rollcall.llm.tables import row_print, stored

K, SPAN = 8, 16
#: What a word of a gap costs; hits that seeds leave out stand in most gaps, so it is small.
COST = 1 / 16
NONE = (float("-inf"), -1)


@dataclass(frozen=True)
class Limits:
    """What counts as a repeated passage, and how far chains reach over gaps."""

    words: int = 40
    share: float = 0.8
    gap: int = 48


def minimizers(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``hashes``) of the smallest of every SPAN runs of one text, and their texts.

    A text with fewer runs gives its smallest; of equal ones the last counts.
    """
    counts = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    best, at = hashes.copy(), np.arange(len(hashes))
    end = bounds[1:][owner]
    # After d steps of doubling, best[i] is the smallest of the runs i .. i + width - 1 within the text.
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        there = np.minimum(np.arange(len(hashes)) + step, end - 1)
        better = best[there] <= best
        best, at = np.where(better, best[there], best), np.where(better, at[there], at)
        width += step
    # Windows that would reach past the end repeat those that end there.
    chosen = np.unique(at[np.arange(len(hashes)) <= np.maximum(end - SPAN, bounds[:-1][owner])])
    return chosen, owner[chosen]


def seeds(texts: DataFrame) -> DataFrame:
    """(seed, doc_id, place, sides) of texts (doc_id, text): sides has 16 bits of each neighbouring run."""

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, part in W.slices(batch.column(1)):
                words = W.split_words(part, W.NON_SPACE, W.LOWER)
                long = np.diff(words.bounds) >= K
                runs, bounds = W.shingles(words, K)
                places, owner = minimizers(runs, bounds)
                keep = long[owner]
                places, owner = places[keep], owner[keep]
                left, right = places - K, places + K
                held = np.zeros((2, len(places)), np.uint32)
                for side, at, inside in ((0, left, left >= bounds[owner]), (1, right, right < bounds[owner + 1])):
                    held[side, inside] = (runs[at[inside]] & np.uint64(0xFFFE)).astype(np.uint32) | 1
                    # No run on this side: a value that no other text's side has, but for chance.
                    held[side, ~inside] = (W.mix(ids[first + owner[~inside]].astype(np.uint64)) & np.uint64(0xFFFE)).astype(np.uint32)
                sides = (held[0] | held[1] << np.uint32(16)).view(np.int32)
                columns = [runs[places].view(np.int64), ids[first + owner], (places - bounds[owner]).astype(np.int32), sides]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "doc_id", "place", "sides"])

    return texts.mapInArrow(sow, "seed long, doc_id long, place int, sides int")


class Latest:
    """Largest (value, chain) over a range of positions, of those entries that have not expired."""

    def __init__(self, size: int):
        self.size = size
        self.best: list[tuple[float, int]] = [NONE] * (2 * size)
        self.held: list[list[tuple[float, int]]] = [[] for _ in range(size)]
        self.gone: set[int] = set()

    def add(self, at: int, value: tuple[float, int]) -> None:
        heappush(self.held[at], (-value[0], -value[1]))
        self._settle(at)

    def expire(self, at: int, chain: int) -> None:
        self.gone.add(chain)
        self._settle(at)

    def _settle(self, at: int) -> None:
        held = self.held[at]
        while held and -held[0][1] in self.gone:
            heappop(held)
        node, value = at + self.size, (-held[0][0], -held[0][1]) if held else NONE
        while node and self.best[node] != value:
            self.best[node] = value
            node //= 2
            value = max(self.best[2 * node], self.best[2 * node + 1]) if node else NONE

    def within(self, low: int, high: int) -> tuple[float, int]:
        """The largest of positions low .. high - 1."""
        found, low, high = NONE, low + self.size, high + self.size
        while low < high:
            if low & 1:
                found, low = max(found, self.best[low]), low + 1
            if high & 1:
                high -= 1
                found = max(found, self.best[high])
            low, high = low // 2, high // 2
        return found


def runs_of_hits(own: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, start in the other, words) of hits on one diagonal at most SPAN apart."""
    order = np.lexsort((own, own - other))
    own, other = own[order], other[order]
    new = np.concatenate([[True], ((own - other)[1:] != (own - other)[:-1]) | (own[1:] > own[:-1] + SPAN)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    return list(zip(own[first].tolist(), other[first].tolist(), (own[last] - own[first] + K).tolist(), strict=True))


def chains(runs: list[tuple[int, int, int]], gap: int) -> list[list[tuple[int, int, int]]]:
    """Best collinear chains, each run in one chain at most.

    A chain scores its runs' words less COST for each word of a gap, in either text, and no gap is longer
    than ``gap`` in either. With score + COST * end kept in the tree, the cost of a gap is added when the next
    run is known. Runs are in the tree only from where they end to ``gap`` words on, and it is asked only for ends in
    reach in the other text, so a better chain out of reach hides none. Stretches further than ``gap``
    apart are chained on their own.
    """
    runs = sorted(runs)
    reach = np.maximum.accumulate([a + n for a, _, n in runs])
    cuts = [at for at in range(1, len(runs)) if runs[at][0] > reach[at - 1] + gap]
    if cuts:
        return [c for low, high in zip([0, *cuts], [*cuts, len(runs)], strict=True) for c in chains(runs[low:high], gap)]
    ends = sorted(range(len(runs)), key=lambda r: runs[r][0] + runs[r][2])
    places = {p: at for at, p in enumerate(sorted({b + n for _, b, n in runs}))}
    stops = sorted(places)
    tree, score, before, waiting, old = Latest(len(places)), [0.0] * len(runs), [-1] * len(runs), 0, 0
    for at, (a, b, n) in enumerate(runs):
        while waiting < len(ends) and sum(runs[ends[waiting]][::2]) <= a:
            r = ends[waiting]
            x, y, size = runs[r]
            tree.add(places[y + size], (score[r] + COST * (x + size + y + size), r))
            waiting += 1
        while old < waiting and sum(runs[ends[old]][::2]) < a - gap:
            tree.expire(places[sum(runs[ends[old]][1:])], ends[old])
            old += 1
        score[at] = n
        value, r = tree.within(bisect_left(stops, b - gap), bisect_right(stops, b))
        joined = value - COST * (a + b) + n
        if r >= 0 and joined > n:
            score[at], before[at] = joined, r
    found, used = [], [False] * len(runs)
    for at in sorted(range(len(runs)), key=lambda r: (-score[r], r)):
        chain = []
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(runs[at])
            at = before[at]
        if chain:
            found.append(chain[::-1])
    return found


def _leading(left: np.ndarray, right: np.ndarray) -> int:
    """How many words agree before the first that does not."""
    size, done, step = min(len(left), len(right)), 0, 64
    while done < size:
        unequal = left[done : min(done + step, size)] != right[done : min(done + step, size)]
        if unequal.any():
            return done + int(unequal.argmax())
        done, step = done + step, 4 * step
    return size


def aligned(own: np.ndarray, other: np.ndarray, chain: list[tuple[int, int, int]], apart: int = 8) -> list[tuple[int, int, int, int, int]]:
    """Parts of a chain over two texts' hashes: (start, end, start in the other, end in the other, agreeing words).

    Runs grow while words agree; a gap in which more than ``apart`` words disagree ends a part.
    """
    parts: list[list[int]] = []
    for x, y, n in chain:
        end, other_end = (parts[-1][1], parts[-1][3]) if parts else (0, 0)
        passed = max(end - x, other_end - y, 0)
        if passed >= n:
            continue
        x, y, n = x + passed, y + passed, n - passed
        grown = _leading(own[end:x][::-1], other[other_end:y][::-1])
        agree = grown + int((own[x : x + n] == other[y : y + n]).sum())
        x, y, n = x - grown, y - grown, n + grown
        more = _leading(own[x + n :], other[y + n :])
        n, agree = n + more, agree + more
        if parts:
            left, right = own[end:x].tolist(), other[other_end:y].tolist()
            masks: dict[int, int] = {}
            for bit, word in enumerate(left):
                masks[word] = masks.get(word, 0) | 1 << bit
            common = common_words(masks, len(left), right) if left and right else 0
            if max(len(left), len(right)) - common <= apart:
                parts[-1][1], parts[-1][3], parts[-1][4] = x + n, y + n, parts[-1][4] + common + agree
                continue
        parts.append([x, x + n, y, y + n, agree])
    return [tuple(x) for x in parts]


def _chained(hits: DataFrame, limits: Limits) -> DataFrame:
    """(doc_id, other_id, runs) of the chains of each pair, from sorted hits (doc_id, other_id, place, other_place, beside).

    K + SPAN - 1 agreeing words around a seed hold the whole run before or after it. A chain of one hit with
    neither (``beside`` tells) is too short to be a part.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, 2):
            ids, others, own, other, beside = (rows.column(k).to_numpy() for k in range(5))
            out = []
            for start, end in zip(bounds, np.append(bounds[1:], rows.num_rows), strict=True):
                if end - start == 1 and not beside[start]:
                    continue
                lone = set(zip(own[start:end][beside[start:end] == 0].tolist(), other[start:end][beside[start:end] == 0].tolist()))
                found = chains(runs_of_hits(own[start:end], other[start:end]), limits.gap)
                found = [[x for run in c for x in run] for c in found if len(c) > 1 or c[0][2] > K or c[0][:2] not in lone]
                if found:
                    out.append((ids[start], others[start], found))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.list_(pa.int32())))], names=["doc_id", "other_id", "runs"])

    return hits.mapInArrow(chain, "doc_id long, other_id long, runs array<array<int>>")


def _aligned(rows: DataFrame, limits: Limits) -> DataFrame:
    """Parts of passages, from (doc_id, other_id, runs, text, other_text)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other_words = None, None
        for batch in batches:
            ids, others, chained = (batch.column(k).to_pylist() for k in range(3))
            for first, texts in W.slices(batch.column(3)):
                words, out = W.split_words(texts, W.NON_SPACE, W.LOWER), []
                for row in range(len(texts)):
                    at = first + row
                    if (text := batch.column(4)[at]) != known:
                        known, text = text, text.as_py()
                        other_words = W.split_words(pa.array([text], pa.large_string()), W.NON_SPACE, W.LOWER).hashes
                    own = words.hashes[words.bounds[row] : words.bounds[row + 1]]
                    for chain in chained[at]:
                        runs = list(zip(*[iter(chain)] * 3, strict=True))
                        if runs[-1][0] + runs[-1][2] > len(own) or runs[-1][1] + runs[-1][2] > len(other_words):
                            continue  # another text of the same id
                        for found in aligned(own, other_words, runs):
                            length = max(found[1] - found[0], found[3] - found[2])
                            if min(found[1] - found[0], found[3] - found[2]) >= K + SPAN - 1 and found[4] >= limits.share * length:
                                out.append((ids[at], others[at], *found))
                if out:
                    names = ["doc_id", "other_id", "first_word", "end_word", "other_first_word", "other_end_word", "agreeing_words"]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    schema = "doc_id long, other_id long, first_word long, end_word long, other_first_word long, other_end_word long, agreeing_words long"
    return rows.mapInArrow(align, schema)


def repeated_passages(documents: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated passages: doc_id, passage_first, passage_end, and the parts that make them up: other_id, first_word,
    end_word, other_first_word, other_end_word, agreeing_words.

    A row links a part of a passage with its like in the first document (by id) that has its seeds; the
    first document's own passages are the ``other`` side of rows. A copy of a whole text of at least
    ``limits.words`` words is a row that covers all of it, linked with the smallest id that has the text.
    Null and short texts, and rows with a null id, have no passages; an id that is a copy of
    another's text counts as a copy only; otherwise, of rows that repeat an id the passages of each text
    count; an empty table gives no rows. Other columns are not read.
    """
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    prints = stored(rows.select("doc_id", *row_print(F.col("text")), n_words.alias("n")), "text-prints")
    firsts = prints.groupBy("print_0", "print_1").agg(F.min("doc_id").alias("other_id"), F.max("doc_id").alias("last")).where("other_id <> last")
    copies = prints.join(stored(firsts.drop("last"), "copied-texts"), ["print_0", "print_1"]).where("doc_id <> other_id")
    copies = stored(copies.select("doc_id", "other_id", "n").distinct(), "copies")
    sown = stored(seeds(rows), "seeds")
    # Of a seed's places in one text the first stands for all on the other side.
    first = sown.groupBy("seed").agg(F.min(F.struct("doc_id", "place", "sides")).alias("first"), F.max("doc_id").alias("last"))
    first = stored(first.where("first.doc_id <> last").select("seed", F.col("first.doc_id").alias("other_id"), F.col("first.place").alias("other_place"), F.col("first.sides").alias("other_sides")), "shared-seeds")
    hits = sown.join(first, "seed").where("doc_id <> other_id")
    differ = F.col("sides").bitwiseXOR(F.col("other_sides"))
    beside = (differ.bitwiseAND(F.lit(0xFFFF)) == 0) | (F.shiftrightunsigned(differ, 16) == 0)
    hits = hits.select("doc_id", "other_id", "place", "other_place", beside.cast("int").alias("beside"))
    hits = hits.join(copies.select("doc_id").distinct(), "doc_id", "left_anti")
    hits = hits.repartition("doc_id", "other_id").sortWithinPartitions("doc_id", "other_id", "place", "other_place")
    found = stored(_chained(hits, limits), "chains")
    needed = stored(found.select("doc_id").union(found.select("other_id")).distinct(), "chained-ids")
    held = stored(rows.join(needed, "doc_id", "left_semi"), "chained-texts")
    pairs = found.join(held, "doc_id").join(held.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other_text")), "other_id")
    passages = _aligned(pairs.select("doc_id", "other_id", "runs", "text", "other_text"), limits).distinct()
    zero = F.lit(0).cast("long")
    whole = copies.where(F.col("n") >= limits.words).select("doc_id", "other_id", zero.alias("first_word"), F.col("n").alias("end_word"), zero.alias("other_first_word"), F.col("n").alias("other_end_word"), F.col("n").alias("agreeing_words"))
    parts = passages.union(whole)
    # A document has no more parts than seeds, so its window is bounded by its text.
    ordered = Window.partitionBy("doc_id").orderBy("first_word", "end_word")
    before = F.max("end_word").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("passage", F.sum(F.when(F.col("first_word") <= before, 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    of_one = Window.partitionBy("doc_id", "passage")
    parts = parts.withColumns({"passage_first": F.min("first_word").over(of_one), "passage_end": F.max("end_word").over(of_one)})
    return parts.where(F.col("passage_end") - F.col("passage_first") >= limits.words).drop("passage")
