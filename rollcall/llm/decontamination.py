r"""Benchmark decontamination: latent semantic retrieval, then word-order and answer checks.

Words are lower-cased runs of letters, digits and everything from U+0080 on. Terms are the words of the
benchmark, a query set of stated size that every task holds, without those that more than a 50th of
its items have; the other words of a text only lengthen its vectors.

1. One pass over all passages (``PASSAGE`` words each) gives document frequencies and, for the term
   counts T of all passages and a random test matrix R, the product T'(T R). With inverse document
   frequencies D, A = T D is the TF-IDF matrix, and D T'T R = A'A (D^-1 R): the product of A'A and
   another test matrix. So one pass serves both, and the Nystroem form of the randomised SVD
   gives the largest singular vectors of A. Only terms x rank sums reach the driver.
2. A second pass projects windows of every text onto the singular vectors, each scaled to equal
   weight, and compares them with the items by cosine. Windows start every ``CHUNK`` words and are long
   enough to hold the item wherever it starts.
3. Each window over the cosine limit is compared with its item, if it has enough of its terms for a
   leak at all, by the longest common subsequence of words
   within a little more than the window. ``share`` of the item's words, in order, is a leak; so
   is ``share_with_answer``, if the words of the item's answer (its last sentence or line) stand
   together in it. Either has ``matched`` words at least. Shorter items leak only where all their words stand
   together, and one or two words only into a text of nothing else.
4. Exact passages do not depend on the cosine: each place of an item's rarest term is a candidate, too, if the
   item's words stand around it.

Items beyond ``BLOCK`` are searched in blocks, a second pass for each. Items longer than ``SEGMENT``
words are searched by segments of near-equal length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import words as W
from rollcall.llm.tables import short, spare, stored

PASSAGE, CHUNK, SEGMENT, MARGIN = 64, 12, 128, 8
BLOCK = 5_000
RANK, EXTRA = 80, 10
SLICE = 1 << 18  # bytes of text searched at once: their vectors stay in a core's cache
SHORT = 8


@dataclass(frozen=True)
class Limits:
    """When a window is a candidate, and when a candidate is a leak.

    A window of a short item holds more other words than item words, so for items under ``long`` words
    the cosine limit shrinks with the square of their length. It is at most ``share_with_answer`` of the cosine
    that the item's own words have in a window whose other words are unlike them.
    """

    cosine: float = 0.38
    long: int = 32
    share: float = 0.8
    share_with_answer: float = 0.6
    matched: int = 8


@dataclass(frozen=True)
class Query:
    """A segment of an item: its words' hashes, and those of its answer (the last segment's only)."""

    item: int
    words: tuple[int, ...]
    answer: tuple[int, ...]


def _hashes(text: str) -> tuple[int, ...]:
    return tuple(W.split_words(pa.array([text], pa.large_string()), W.ALPHANUMERIC, W.LOWER).hashes.tolist())


def queries_of(items: list[tuple[int, str | None]]) -> list[Query]:
    """Segments of all items that have words."""
    found = []
    for item, text in items:
        words = _hashes(text or "")
        parts = [p for p in (_hashes(x) for x in re.split(r"(?<=[.?!])\s+|\n", text or "")) if len(p) > 2]
        count = -(-len(words) // SEGMENT)
        cuts = [len(words) * k // count for k in range(count + 1)] if count else []
        for start, end in zip(cuts, cuts[1:]):
            found.append(Query(item, words[start:end], parts[-1] if end == len(words) and len(parts) > 1 else ()))
    return found


class Known:
    """Finds known words by the leading bits of their hashes, few of which share a slot."""

    def __init__(self, hashes: set[int]):
        self.known = np.array(sorted(hashes) or [0], np.uint64)
        bits = (8 * len(self.known)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.known >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.held = np.diff(self.first) > 0
        self.steps = int(np.diff(self.first).max()) - 1

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, which) of the words that are known."""
        slots = (hashes >> self.shift).astype(np.int64)
        where = np.flatnonzero(self.held[slots])
        at, wanted = self.first[slots[where]].astype(np.int64), hashes[where]
        for _ in range(self.steps):
            at = np.minimum(at + (self.known[at] < wanted), len(self.known) - 1)
        same = self.known[at] == wanted
        return where[same], at[same]


class Terms(Known):
    """The benchmark words that tell items apart, by hash; of each segment the six rarest at least."""

    def __init__(self, queries: list[Query]):
        held = Counter(w for q in queries for w in set(q.words))
        most = max(3, len(queries) // 50)
        kept = {w for w, n in held.items() if n <= most}
        for q in queries:
            kept |= set(sorted(set(q.words), key=lambda w: (held[w], w))[:6])
        super().__init__(kept)


def _sums(table: np.ndarray, rows: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
    """Sums of ``table[rows]`` by group number (not decreasing), for groups 0 to count - 1.

    Groups of up to ``SHORT`` rows are summed together, the third row of each to the second, then the fourth; that is
    the order in which reduceat adds them, too, so sums do not depend on which way a group takes.
    """
    result = np.zeros((count, table.shape[1]), table.dtype)
    if not len(groups):
        return result
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(groups)))
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        values = table[rows[np.repeat(sizes > SHORT, sizes)]]
        result[groups[starts[long]]] = np.add.reduceat(values, np.cumsum(sizes[long]) - sizes[long], axis=0)
    order = np.argsort(-sizes, kind="stable")[len(long) :]
    starts, sizes = starts[order], sizes[order]
    longer = len(sizes) - np.cumsum(np.bincount(sizes, minlength=2))  # at k: groups of more than k rows
    sums, others = table[rows[starts]], table[rows[starts[: longer[1]] + 1]]
    for step in range(2, len(longer) - 1):
        others[: longer[step]] += table[rows[starts[: longer[step]] + step]]
    sums[: len(others)] += others
    result[groups[starts]] = sums
    return result


def latent_terms(documents: DataFrame, terms: Terms, rank: int = RANK, extra: int = EXTRA, text: str = "text", seed: int = 17) -> np.ndarray:
    """terms x rank: inverse document frequency times singular vector, each scaled to equal weight.

    Frequencies and the product cover all passages of all texts.
    """
    size, width = len(terms.known), min(rank + extra, len(terms.known))
    test = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, frequency, passages = np.zeros((size, width)), np.zeros(size), 0
        for batch in batches:
            for _, texts in W.slices(batch.column(0)):
                words = W.split_words(texts, W.ALPHANUMERIC, W.LOWER)
                counts = -(-np.diff(words.bounds) // PASSAGE)
                firsts = np.cumsum(counts) - counts
                where, which = terms.of(words.hashes)
                if not len(where):
                    passages += int(counts.sum())
                    continue
                owner = np.searchsorted(words.bounds, where, "right") - 1
                passage = firsts[owner] + (where - words.bounds[owner]) // PASSAGE
                total = int(counts.sum())
                projected = _sums(test, which, passage, total)
                order = np.argsort(which.astype(np.uint16) if size < 1 << 16 else which, kind="stable")
                which, passage = which[order], passage[order]
                product += _sums(projected, passage, which, size)
                new = np.concatenate([[True], (which[1:] != which[:-1]) | (passage[1:] != passage[:-1])])
                frequency += np.bincount(which[new], minlength=size)
                passages += total
        held = np.flatnonzero(frequency)
        columns = [pa.array(np.append(held, -1)), pa.array(np.append(frequency[held], passages))]
        columns += [pa.array(np.append(product[held, k], 0.0)) for k in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "n", *(f"p{k}" for k in range(width))])

    names = ["n", *(f"p{k}" for k in range(width))]
    parts = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(multiply, ", ".join(["term long", *(f"{x} double" for x in names)]))
    rows = parts.groupBy("term").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
    whole = rows.term < 0
    passages = float(rows[whole].n.sum())
    product, frequency = np.zeros((size, width)), np.zeros(size)
    product[rows.term[~whole]] = rows.loc[~whole, names[1:]].to_numpy()
    frequency[rows.term[~whole]] = rows.n[~whole]
    weight = np.log((passages + 1) / (frequency + 1)) + 0.01
    core = test.T.astype(float) @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-9 + 1e-12
    if not good.any():
        return np.zeros((size, 1), np.float32)
    half = (weight[:, None] * product) @ (vectors[:, good] / np.sqrt(values[good]))
    left, singular, _ = np.linalg.svd(half, full_matrices=False)
    keep = min(rank, int((singular > singular[0] * 1e-6).sum()))
    return (weight[:, None] * left[:, :keep] / singular[:keep]).astype(np.float32)


def common_words(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, all rows of the table at once in an integer's bits."""
    full = (1 << size) - 1
    row = full
    for word in words:
        met = row & masks.get(word, 0)
        row = ((row + met) | (row - met)) & full
    return size - row.bit_count()


def _together(part: tuple[int, ...], words: list[int]) -> bool:
    return any(tuple(words[i : i + len(part)]) == part for i in range(len(words) - len(part) + 1))


@dataclass
class Search:
    """Compares all windows of texts with queries."""

    queries: list[Query]
    terms: Terms
    vectors: np.ndarray
    limits: Limits

    def __post_init__(self) -> None:
        norms = np.linalg.norm(self.vectors, axis=1)
        self.other = float(np.median(norms) ** 2)  # what a word outside the terms adds to a squared length
        groups, owners, n_terms, self.needs, self.masks = {}, [], [], [], []
        targets = np.zeros((len(self.queries), self.vectors.shape[1]), np.float32)
        for at, q in enumerate(self.queries):
            groups.setdefault(-(-(len(q.words) + CHUNK - 1) // CHUNK), []).append(at)
            held = self.terms.of(np.array(q.words, np.uint64))[1]
            targets[at] = self.vectors[held].sum(axis=0)
            n_terms.append(len(held))
            owners += [(term, at) for term in set(held.tolist())]
            # A leak has so many of the item's words; those that are no terms may be among them.
            self.needs.append(max(math.ceil(self.limits.share_with_answer * len(q.words)) - (len(q.words) - len(held)), 0))
            masks: dict[int, int] = {}
            for bit, word in enumerate(q.words):
                masks[word] = masks.get(word, 0) | 1 << bit
            self.masks.append(masks)
        norms = np.linalg.norm(targets, axis=1)
        targets /= np.maximum(norms, 1e-12)[:, None]
        self.groups = {chunks: (np.array(at), np.ascontiguousarray(targets[at].T)) for chunks, at in sorted(groups.items())}
        self.place = {int(q): (chunks, column) for chunks, (members, _) in self.groups.items() for column, q in enumerate(members)}
        owners = np.array(sorted(owners), np.int64).reshape(-1, 2)
        self.owners, self.first_owner = owners[:, 1], np.searchsorted(owners[:, 0], np.arange(len(self.terms.known) + 1))
        self.needs = np.array(self.needs)
        lengths = np.array([len(q.words) for q in self.queries])
        self.n_terms = np.array(n_terms)
        windows = -(-(lengths + CHUNK - 1) // CHUNK) * CHUNK
        own = norms / np.sqrt(np.maximum(norms**2 + self.other * (windows - self.n_terms), 1e-12))
        least = np.minimum(self.limits.cosine * np.minimum(1, lengths / self.limits.long) ** 2, self.limits.share_with_answer * own)
        self.least = least.astype(np.float32)
        # Of each query the term that fewest queries have, and where it stands: sorted by term.
        shared, anchors = np.diff(self.first_owner), []
        for at, q in enumerate(self.queries):
            where, which = self.terms.of(np.array(q.words, np.uint64))
            k = int(shared[which].argmin())
            anchors.append((int(which[k]), at, int(where[k])))
        anchors = np.array(sorted(anchors), np.int64).reshape(-1, 3)
        self.anchors, self.first_anchor = anchors[:, 1:], np.searchsorted(anchors[:, 0], np.arange(len(self.terms.known) + 1))
        self.lengths, self.ends = lengths, np.array([[q.words[0], q.words[-1]] for q in self.queries], np.uint64)
        # Words of queries that are no terms, as bits: which of them each query has.
        self.common = Known({w for q in self.queries for w in q.words} - set(self.terms.known.tolist()))
        self.bits = np.zeros((-(-len(self.common.known) // 64), len(self.queries)), np.uint64)
        for at, q in enumerate(self.queries):
            which = np.unique(self.common.of(np.array(q.words, np.uint64))[1])
            np.bitwise_or.at(self.bits[:, at], which >> 6, np.uint64(1) << (which & 63).astype(np.uint64))
        self.repeated = np.array([len(q.words) - len(set(q.words)) for q in self.queries])

    def exact(self, words: W.Words, where: np.ndarray, which: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, text, place) where a query's words stand together, from the places of terms and their texts."""
        repeats = self.first_anchor[which + 1] - self.first_anchor[which]
        ends = np.cumsum(repeats)
        rows = np.repeat(self.first_anchor[which] - (ends - repeats), repeats) + np.arange(ends[-1])
        numbers, offsets = self.anchors[rows].T
        text, first = np.repeat(owner, repeats), np.repeat(where, repeats) - offsets
        last = first + self.lengths[numbers] - 1
        good = np.flatnonzero((first >= words.bounds[text]) & (last < words.bounds[text + 1]))
        for side, at in enumerate((first, last)):
            good = good[words.hashes[at[good]] == self.ends[numbers[good], side]]
        found = zip(numbers[good].tolist(), text[good].tolist(), first[good].tolist(), strict=True)
        return [(q, t, at - int(words.bounds[t])) for q, t, at in found if tuple(words.hashes[at : at + self.lengths[q]].tolist()) == self.queries[q].words]

    def candidates(self, words: W.Words) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, window start, window words, query, cosine) over the cosine limit with terms enough, and of exact passages.

        Without those that have too few of the query's words, by a count that is never too small: the common ones by bits
        of chunks, the places of terms, and all that repeat a word of the query, up to the chunks that the margin touches.
        """
        sizes = np.diff(words.bounds)
        counts = -(-sizes // CHUNK)
        firsts = np.cumsum(counts) - counts
        total = int(counts.sum())
        where, which = self.terms.of(words.hashes)
        if not len(where):
            return
        text_of = np.repeat(np.arange(len(sizes)), counts)
        place = np.arange(total) - firsts[text_of]
        held = np.minimum(sizes[text_of] - place * CHUNK, CHUNK)
        chunk_of = np.repeat(np.arange(total), held)
        chunk = chunk_of[where]
        owner = text_of[chunk]
        running = np.zeros((total + 1, self.vectors.shape[1]), np.float64)
        np.cumsum(_sums(self.vectors, which, chunk, total), axis=0, out=running[1:])
        others = np.concatenate([[0], np.cumsum(held - np.bincount(chunk, minlength=total))])
        # Where queries' terms are: sorted by query, then chunk.
        repeats = self.first_owner[which + 1] - self.first_owner[which]
        ends = np.cumsum(repeats)
        at = np.repeat(self.first_owner[which] - (ends - repeats), repeats) + np.arange(ends[-1])
        hits = np.sort(self.owners[at] * (total + 1) + np.repeat(chunk, repeats))
        last = (firsts + counts)[text_of]
        reach = -(-MARGIN // CHUNK)
        bits = np.zeros((len(self.bits), reach + total + max(self.groups) + reach), np.uint64)
        place_of, common = self.common.of(words.hashes)
        np.bitwise_or.at(bits.reshape(-1), (common >> 6) * bits.shape[1] + reach + chunk_of[place_of], np.uint64(1) << (common & 63).astype(np.uint64))
        exact: dict[int, list[tuple[int, int]]] = {}
        for number, text, at in self.exact(words, where, which, owner):
            chunks, column = self.place[number]
            exact.setdefault(chunks, []).append((int(firsts[text]) + at // CHUNK, column))
        for chunks, (members, targets) in self.groups.items():
            stop = np.minimum(np.arange(total) + chunks, last)
            vectors = (running[stop] - running[:-1]).astype(np.float32)
            length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors) + self.other * (others[stop] - others[:-1]))
            vectors /= np.maximum(length, 1e-9)[:, None].astype(np.float32)
            cosines = vectors @ targets
            over = cosines >= self.least[members]
            if chunks in exact:
                over[tuple(np.array(exact[chunks]).T)] = True
            rows, columns = np.nonzero(over)
            seen = bits[:, :total].copy()
            for step in range(1, chunks + 2 * reach):
                seen |= bits[:, step : step + total]
            numbers, present = members[columns], self.repeated[members[columns]]
            for seen_bits, query_bits in zip(seen, self.bits, strict=True):
                present += np.bitwise_count(seen_bits[rows] & query_bits[numbers])
            least = self.limits.share_with_answer * self.lengths[numbers]
            good = np.flatnonzero(present + self.n_terms[numbers] >= least)
            rows, columns, numbers, present, least = rows[good], columns[good], numbers[good], present[good], least[good]
            base, ends = numbers * (total + 1), stop[rows]
            low, high = np.maximum(rows - reach, firsts[text_of[rows]]), np.minimum(ends + reach, last[rows])
            good = np.flatnonzero(present + np.searchsorted(hits, base + high) - np.searchsorted(hits, base + low) >= least)
            found = np.searchsorted(hits, base[good] + ends[good]) - np.searchsorted(hits, base[good] + rows[good])
            good = good[found >= self.needs[numbers[good]]]
            for row, number, cosine in zip(rows[good].tolist(), numbers[good].tolist(), cosines[rows[good], columns[good]].tolist(), strict=True):
                yield int(text_of[row]), int(place[row]) * CHUNK, chunks * CHUNK, number, cosine

    def leaks(self, words: W.Words) -> Iterator[tuple[int, int, int, int, int, int, float]]:
        """(text, item, first word, end, common words, item words, cosine): the best window of each text and item."""
        best: dict[tuple[int, int], tuple] = {}
        for text, start, span, at, cosine in self.candidates(words):
            query = self.queries[at]
            low = max(start - MARGIN, 0)
            high = min(start + span + MARGIN, int(words.bounds[text + 1] - words.bounds[text]))
            window = words.hashes[words.bounds[text] + low : words.bounds[text] + high].tolist()
            present = 0
            for mask in map(self.masks[at].get, set(window) & self.masks[at].keys()):
                present |= mask
            if present.bit_count() < self.limits.share_with_answer * len(query.words):
                continue
            common = common_words(self.masks[at], len(query.words), window)
            share = common / len(query.words)
            if common < self.limits.matched:
                alone = len(query.words) > 2 or int(words.bounds[text + 1] - words.bounds[text]) == len(query.words)
                if common < len(query.words) or not alone or not _together(query.words, window):
                    continue
            if share >= self.limits.share or (share >= self.limits.share_with_answer and query.answer and _together(query.answer, window)):
                found = (common, -low, text, query.item, low, high, common, len(query.words), cosine)
                if (text, query.item) not in best or found > best[text, query.item]:
                    best[text, query.item] = found
        for found in best.values():
            yield found[2:]


def leaks(documents: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, end_word, common_words, item_words, cosine): a row for each document row and item that leaks into it.

    Of several windows with one item, the one with the most common words counts (ties: the first).
    Null and wordless texts and items have no matches; nulls in ``key`` stay null, items with a null id are passed over;
    repeated document rows get rows each, repeated items count once; empty tables give no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    rows = benchmark.select(F.col(item).cast("long"), F.col(item_text).cast("string")).where(F.col(item).isNotNull()).distinct()
    queries = queries_of(sorted((tuple(r) for r in rows.toLocalIterator()), key=str))
    kind = dict(documents.select(F.col(key)).dtypes)[key]
    schema = f"{key} {kind}, {item} long, first_word long, end_word long, common_words long, item_words long, cosine double"
    result = spark.createDataFrame([], schema)
    if not queries:
        return result
    terms = Terms(queries)
    vectors = latent_terms(documents, terms, text=text)
    frame = documents.select(F.col(key), F.col(text).cast("string").alias("text"))

    def searcher(block: list[Query]):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searched = Search(block, terms, vectors, limits)
            for batch in batches:
                for first, texts in W.slices(batch.column(1), SLICE):
                    found = list(searched.leaks(W.split_words(texts, W.ALPHANUMERIC, W.LOWER)))
                    if found:
                        at, *rest = zip(*found, strict=True)
                        columns = [batch.column(0).slice(first, len(texts)).take(pa.array(at)), *(pa.array(x) for x in rest)]
                        yield pa.RecordBatch.from_arrays(columns, names=[key, item, "first_word", "end_word", "common_words", "item_words", "cosine"])

        return frame.mapInArrow(search, schema)

    blocks = [searcher(queries[at : at + BLOCK]) for at in range(0, math.ceil(len(queries) / BLOCK) * BLOCK, BLOCK)]
    result = blocks[0]
    for block in blocks[1:]:
        result = result.union(block)
    return result


def decontaminated(documents: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that leak an item, with all their columns.

    Rows with a null key, and with null, empty or wordless texts, stay. Rows that repeat a key go if one of them leaks. Columns of
    any name pass through; an empty table gives no rows, and an empty benchmark drops none.
    """
    name = spare(documents, "leaking")
    found = stored(leaks(documents, benchmark, limits, key, text).select(F.col(key).alias(name)).distinct(), "leaking")
    return documents.join(short(found), F.col(key) == F.col(name), "left_anti")
