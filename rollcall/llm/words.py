"""Words of Arrow string columns as numpy arrays, without a Python object per word.

A batch is cut into slices of about a megabyte, so memory does not follow the size of an
Arrow batch (a longer single text is a slice of its own). Words are runs of bytes of one
class; UTF-8 bytes from 0x80 never are white space, so byte runs are code point runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
#: Bytes of words of the class [^\x20\x09-\x0D].
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes of words of lower-cased letters, digits and everything from U+0080 on.
ALPHANUMERIC = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)
SAME = _BYTES.astype(np.uint8)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        size = max(count, 2 * SLICE_BYTES)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = known
    return known[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: ``hashes[bounds[i]:bounds[i + 1]]`` are those of text i."""

    data: np.ndarray  # bytes of all texts
    texts: np.ndarray  # byte offsets of the texts in data, one more than texts
    starts: np.ndarray  # byte offsets of words
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def word(self, index: int) -> bytes:
        return self.data[self.starts[index] : self.ends[index]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts without nulls) of about ``budget`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + budget, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, column.slice(first, last - first)
        first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, member: np.ndarray = NON_SPACE, fold: np.ndarray = SAME, hashed: bool = True) -> Words:
    """Words of each text (a large_string array without nulls) with 64-bit hashes of their bytes.

    ``member`` tells word bytes from others, ``fold`` maps bytes before they are hashed.
    """
    data, offsets = text_bytes(texts)
    inside = member[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[offsets < len(data)]
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        after[-1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), spans_hash(fold[data], starts, ends) if hashed else np.zeros(0, np.uint64))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one running sum over all bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts])


def hash_of(word: str) -> int:
    """The hash :func:`split_words` gives to a word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return int(mix((data * _power(_BASE, len(data))).sum(dtype=np.uint64).reshape(1))[0])


def shingles(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``length`` words within one text, and their bounds by text.

    A text with words but fewer than ``length`` has one run, of all its words.
    """
    counts = np.diff(words.bounds)
    total = len(words.hashes)
    values = np.zeros(max(total - length + 1, 0), dtype=np.uint64)
    for step in range(length):
        part = words.hashes[step : step + len(values)]
        values = mix(values * np.uint64(0xD6E8FEB86659FD93) + part)
    runs = np.maximum(counts - length + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    owner = np.repeat(np.arange(len(counts)), runs)
    place = np.arange(bounds[-1]) - bounds[:-1][owner] + words.bounds[:-1][owner]
    result = np.zeros(bounds[-1], dtype=np.uint64)
    whole = counts[owner] >= length
    result[whole] = values[place[whole]]
    for text in np.flatnonzero((counts > 0) & (counts < length)):
        value = np.zeros(1, np.uint64)
        for part in words.hashes[words.bounds[text] : words.bounds[text + 1]]:
            value = mix(value * np.uint64(0xD6E8FEB86659FD93) + part)
        result[bounds[text]] = mix(value + np.uint64(counts[text]))[0]
    return result, bounds
