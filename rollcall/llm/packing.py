"""Packing of tokenised examples into sequences: vector bin packing by dot product."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import words as W

#: Fixed value: the id that ends every document.
END_ID = 1


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


class WordTokenizer:
    """Ids of whole texts, with each distinct word tokenised once.

    Holds for vocabularies that lower-case, whose pre-tokenizer drops white space, sets
    punctuation apart from letters and never joins what stands on both sides of white
    space, so ids of a text are those of its words in order. Words of ASCII bytes are looked up
    in lower case and without the dots and commas that end them. The memory of known words is
    emptied when it passes ``known`` words.
    """

    def __init__(self, path: str, known: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        # A worker process runs many tasks, each with its own copy of this code: the vocabulary stays with the library.
        loaded = tokenizers.__dict__.setdefault("_rollcall_loaded", {})
        if path not in loaded:
            loaded[path] = tokenizers.Tokenizer.from_file(path)
        self.tokenizer, self.known = loaded[path], known
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        tokenize, found = self.tokenizer.model.tokenize, [None] * len(words)
        for at, word in enumerate(words):
            # Lower-case letters only: all of the word is one pre-token, and the model can be asked directly.
            if word.isalpha() and word.lower() == word and (word.isascii() or is_normalized("NFC", word)):
                found[at] = [x.id for x in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_SIGNS))]
        rest = [at for at, ids in enumerate(found) if ids is None]
        for at, got in zip(rest, self.tokenizer.encode_batch_fast([words[at] for at in rest], add_special_tokens=False), strict=True):
            found[at] = got.ids
        counts = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        slot = len(self.slot)
        self.first, self.count = _grown(self.first, slot + len(keys)), _grown(self.count, slot + len(keys))
        self.pool = _grown(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[slot : slot + len(keys)] = self.used + np.cumsum(counts) - counts
        self.count[slot : slot + len(keys)] = counts
        self.used += len(flat)
        self.slot.update(zip(keys, range(slot, slot + len(keys)), strict=True))

    def _slots(self, words: W.Words) -> np.ndarray:
        """Where each word's ids are, learning new words."""
        unique, example, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        keys = unique.tolist()
        new = [i for i, key in enumerate(keys) if key not in self.slot]
        if new:
            self._learn([keys[i] for i in new], [words.word(i).decode() for i in example[new].tolist()])
        return np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))[inverse]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their bounds by text."""
        if len(self.slot) > self.known:
            self._forget()
        slots, bounds = self._slots(words := plain_words(W.split_words(texts, hashed=False))), words.bounds
        lengths = self.count[slots].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.first[slots] - (ends - lengths), lengths) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[bounds]


class TableTokenizer(WordTokenizer):
    """The same ids, with known words looked up for a whole slice at once in a table of hashes with open addresses."""

    def _forget(self) -> None:
        super()._forget()
        self.keys, self.at = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is not known."""
        mask = np.uint64(len(self.keys) - 1)
        place = (hashes & mask).astype(np.int64)
        held = self.keys[place]
        slots = np.where(held == hashes, self.at[place], -1)
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & int(mask)
            held = self.keys[place[open_]]
            hit = held == hashes[open_]
            slots[open_[hit]] = self.at[place[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return slots

    def _enter(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        """Put distinct new hashes into the table."""
        mask = len(self.keys) - 1
        place = (hashes & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[place[left]] == 0
            self.keys[place[left[free]]] = hashes[left[free]]
            done = free & (self.keys[place[left]] == hashes[left])
            self.at[place[left[done]]] = slots[left[done]]
            left = left[~done]
            place[left] = (place[left] + 1) & mask

    def _slots(self, words: W.Words) -> np.ndarray:
        hashes = np.maximum(words.hashes, np.uint64(1))  # 0 marks a free place
        slots = self._found(hashes)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new, example = np.unique(hashes[missing], return_index=True)
            known = len(self.slot)
            self._learn(new.tolist(), [words.word(i).decode() for i in missing[example].tolist()])
            if 2 * len(self.slot) > len(self.keys):
                old, size = self.slot, 1 << (4 * len(self.slot)).bit_length()
                self.keys, self.at = np.zeros(size, np.uint64), np.zeros(size, np.int32)
                self._enter(np.fromiter(old, np.uint64, len(old)), np.fromiter(old.values(), np.int32, len(old)))
            else:
                self._enter(new, np.arange(known, known + len(new), dtype=np.int32))
            slots[missing] = self._found(hashes[missing])
        return slots


#: How byte-level vocabularies write bytes: visible ones as they are, the others from U+0100 on in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {byte: 256 + at for at, byte in enumerate(sorted(set(range(256)) - set(_SHOWN)))}

_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".,", np.uint8))
#: Words with these bytes are looked up as they are: composition may depend on case above
#: ASCII, and special tokens are written with angle brackets.
_LITERAL = np.arange(256) >= 0x80
_LITERAL[ord("<")] = True


def plain_words(words: W.Words) -> W.Words:
    """The words with dots and commas after their last letter as words of their own, in lower case if ASCII."""
    starts, ends, data = words.starts, words.ends, words.data
    if not len(starts):
        return words
    stop = _STOP[data[ends - 1]] & (ends - starts > 1)
    stop[stop] = _LETTER[data[ends[stop] - 2]]  # exactly one stop after a letter
    cut = np.flatnonzero(stop)
    starts = np.insert(starts, cut + 1, ends[cut] - 1)
    ends = np.insert(ends, cut, ends[cut] - 1)
    literal = np.concatenate([[0], np.cumsum(_LITERAL[data])])
    plain = literal[ends] == literal[starts]
    data = W.LOWER[data] if plain.all() else _lowered(data, starts[plain], ends[plain])
    return W.Words(data, words.texts, starts, ends, np.searchsorted(starts, words.texts), W.spans_hash(data, starts, ends))


def _lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes with those of the given spans in lower case."""
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    return np.where(np.cumsum(change[:-1], dtype=np.int8) > 0, W.LOWER[data], data)


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` values."""
    if size <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)])


@dataclass
class _Item:
    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None
    whole: int


@dataclass
class Packer:
    """Examples of one partition become sequences.

    Example pieces that fill a sequence on their own leave at once; what remains of each
    example waits in a pool. A sequence takes from the pool, again and again, the piece with the
    largest dot product of its needs and what is still free, both as shares of the limits.
    When no whole piece fits, the largest is cut to fill the rest. ``pool`` bounds the memory,
    not the examples: when it is full, a sequence is closed.
    """

    limits: Limits
    first_sequence: int
    pool: int = 2048
    items: list[_Item] = field(default_factory=list)
    sequence: int = 0

    def __post_init__(self) -> None:
        self.needs = np.zeros((self.pool + 8, 3))
        self.caps = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        self.out: list[tuple] = []
        self.loss: list[int] = []  # of each piece in ``out``

    def _longest(self, item: _Item, tokens: int, loss: int) -> int:
        """How many of the item's first tokens fit."""
        tokens = min(tokens, len(item.ids))
        if item.loss is None:
            return min(tokens, loss)
        return min(tokens, int(np.searchsorted(np.cumsum(item.loss), loss, side="right")))

    def _emit(self, item: _Item, length: int, offset: int) -> None:
        self.out.append((item.key, item.start, item.ids[:length], item.whole, self.first_sequence + self.sequence, offset))
        self.loss.append(length if item.loss is None else int(item.loss[:length].sum()))

    def _rest(self, item: _Item, length: int) -> _Item | None:
        if length == len(item.ids):
            return None
        return _Item(item.key, item.start + length, item.ids[length:], None if item.loss is None else item.loss[length:], item.whole)

    def _put(self, item: _Item) -> None:
        loss = len(item.ids) if item.loss is None else int(item.loss.sum())
        self.needs[len(self.items)] = (len(item.ids), 1, loss)
        self.items.append(item)

    def _take(self, index: int) -> _Item:
        item, last = self.items[index], len(self.items) - 1
        self.items[index], self.needs[index] = self.items[last], self.needs[last]
        self.items.pop()
        return item

    def add(self, key: object, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        """One example with at least one id; ``loss`` marks loss-bearing ids (None: all are)."""
        item: _Item | None = _Item(key, 0, ids, loss, len(ids))
        while item is not None:
            length = self._longest(item, self.limits.tokens, self.limits.loss_tokens)
            if length < self.limits.tokens and length == len(item.ids):
                break
            length = max(length, 1)
            self._emit(item, length, 0)
            self.sequence += 1
            item = self._rest(item, length)
        if item is not None:
            self._put(item)
        while len(self.items) >= self.pool:
            self._close(self.limits.tokens)

    def _close(self, tokens: int) -> None:
        """Fill one sequence of at most ``tokens`` tokens."""
        free, offset = np.array([tokens, self.caps[1], self.caps[2]]), 0
        while self.items:
            needs = self.needs[: len(self.items)]
            fits = (needs <= free).all(axis=1)
            if not fits.any():
                break
            gain = needs @ (free / self.caps**2)
            gain[~fits] = -1
            item = self._take(int(gain.argmax()))
            self._emit(item, len(item.ids), offset)
            offset += len(item.ids)
            free -= (len(item.ids), 1, len(item.ids) if item.loss is None else item.loss.sum())
        if self.items and free[0] >= 1 and free[1] >= 1:
            index = int(self.needs[: len(self.items), 0].argmax())
            length = self._longest(self.items[index], int(free[0]), int(free[2]))
            if length:
                item = self._take(index)
                self._emit(item, length, offset)
                rest = self._rest(item, length)
                if rest is not None:
                    self._put(rest)
        self.sequence += 1

    def finish(self) -> None:
        """Empty the pool; the last tokens go to sequences of a power of two each, which need no padding."""
        while self.items:
            left = int(self.needs[: len(self.items), 0].sum())
            self._close(self.limits.tokens if left >= self.limits.tokens else 1 << (left.bit_length() - 1))


def tokenizer_path() -> str:
    """The default vocabulary, where the worker has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(documents: DataFrame, limits: Limits = Limits(), vocabulary: str | None = None, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``limits.tokens`` ids.

    A document's ids are those of its text (null: empty) followed by ``END_ID``. Each id is
    in exactly one piece; pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, if asked for, the ids. Each input partition is packed where it is read, in row order,
    with no shuffle; a lost task is redone from its input and its sequences carry the
    partition's number, so ids of sequences never clash. Sequences hold pieces of one partition.

    An empty or null text has one piece of one id; a null key stays null; repeated rows are
    packed each; an empty table gives no piece; other columns are not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = TableTokenizer(vocabulary or tokenizer_path())
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in W.slices(batch.column(1)):
                ids, bounds = tokenizer.encode(texts)
                for row in range(len(texts)):
                    packer.add(keys[first + row], np.concatenate([ids[bounds[row] : bounds[row + 1]], end]))
                if packer.out:
                    yield _pieces(packer, with_ids, batch.schema.field(0).type)
        packer.finish()
        if packer.out:
            yield _pieces(packer, with_ids, batch.schema.field(0).type)

    frame = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return frame.mapInArrow(pack, _schema(frame, key, with_ids))


def _schema(frame: DataFrame, key: str, with_ids: bool) -> str:
    """Columns of pieces; the key, of any type, keeps its own."""
    columns = f"`{key}` {dict(frame.dtypes)['key']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return columns + (", ids array<int>" if with_ids else "")


def pack_examples(examples: DataFrame, limits: Limits, vocabulary: str | None = None, with_ids: bool = False, key: str = "conv_id", parts: str = "parts") -> DataFrame:
    """Pack examples for instruction tuning, of which only some parts bear loss, as :func:`pack_documents` packs documents.

    ``parts`` is an array of (text, loss) in order, such as the turns of a conversation with loss on the answers. An example's ids are
    those of its parts, each tokenised on its own, then ``END_ID``, which bears loss as the last part does. Pieces have a column
    ``loss_tokens`` more. A null part or text is empty, a null mark bears no loss; a null or empty array has one piece of one id without loss.
    Null keys, repeated rows, empty tables and other columns: as there. Ids and marks of one example are held in its task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = TableTokenizer(vocabulary or tokenizer_path())
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        held: list[tuple[np.ndarray, bool]] = []

        def finished(example: object) -> None:
            last = bool(held and held[-1][1])
            ids = np.concatenate([*(ids for ids, _ in held), np.array([END_ID], np.uint32)])
            loss = np.concatenate([*(np.full(len(ids), mark) for ids, mark in held), [last]]).astype(bool)
            held.clear()
            packer.add(example, ids, loss)

        for batch in batches:
            keys, row = batch.column(0).to_pylist(), 0
            owners = np.repeat(np.arange(len(keys)), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
            flat = pc.list_flatten(batch.column(1))
            marks = pc.fill_null(pc.struct_field(flat, "loss"), False).to_numpy(zero_copy_only=False)
            for first, texts in W.slices(pc.struct_field(flat, "text")):
                ids, bounds = tokenizer.encode(texts)
                for at in range(len(texts)):
                    while row < owners[first + at]:
                        finished(keys[row])
                        row += 1
                    held.append((ids[bounds[at] : bounds[at + 1]], bool(marks[first + at])))
                if packer.out:
                    yield _pieces(packer, with_ids, batch.schema.field(0).type, True)
            for example in keys[row:]:
                finished(example)
            if packer.out:
                yield _pieces(packer, with_ids, batch.schema.field(0).type, True)
        packer.finish()
        if packer.out:
            yield _pieces(packer, with_ids, batch.schema.field(0).type, True)

    frame = examples.select(F.col(key).alias("key"), F.col(parts).cast("array<struct<text:string,loss:boolean>>").alias("parts"))
    return frame.mapInArrow(pack, _schema(frame, key, with_ids) + ", loss_tokens long")


def _pieces(packer: Packer, with_ids: bool, key_type: pa.DataType, with_loss: bool = False) -> pa.RecordBatch:
    rows, packer.out = packer.out, []
    loss, packer.loss = packer.loss, []
    keys, starts, ids, whole, sequences, offsets = zip(*rows, strict=True)
    lengths = [len(x) for x in ids]
    columns = [
        pa.array(keys, key_type),
        pa.array(starts, pa.int64()),
        pa.array(lengths, pa.int64()),
        pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], pa.int64()),
        pa.array(whole, pa.int64()),
        pa.array(sequences, pa.int64()),
        pa.array(offsets, pa.int64()),
    ]
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype(np.int32))))
        names.append("ids")
    if with_loss:
        columns.append(pa.array(loss, pa.int64()))
        names.append("loss_tokens")
    return pa.RecordBatch.from_arrays(columns, names=names)
