r"""Fill-in-the-middle transformation: two cuts between tokens, the middle moved to the end.

A token is white space before a word together with the word, or white space that ends the text
(space and U+0009 to U+000D). One full match of ``(token)*`` by the ``regex`` library keeps every repetition
of its group, so the ends of a match's captures are all places where a text can be cut: their number is n,
and both cuts are looked up among them. The pattern is possessive: nothing is tried twice, and a match takes time in proportion
to the text. A match needs memory for each capture, so a text of more than ``PIECE`` code points is matched in
pieces that end where a token does; the ends found are those of one match of the whole.

Where a text is cut follows from a keyed hash of the document's key alone, so a task that is run again, or another order of
rows, gives the same output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm import words as W
from rollcall.llm.tables import spare

#: What marks the parts, and a token.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = r"\x20\x09-\x0D"
TOKEN = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Code points matched at once.
PIECE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """How documents are cut: ``seed`` keys the hash, ``rate`` percent are transformed, ``spm`` percent of those with the suffix first."""

    seed: int = 42
    rate: int = 50
    spm: int = 80


class TokenEnds:
    """Where the tokens of a text end, in code points."""

    def __init__(self):
        import regex

        possessive = TOKEN.replace("]*", "]*+").replace("]+", "]++")
        self.tokens = regex.compile(f"((?>{possessive}))*+")
        self.edge = regex.compile(rf"[^{SPACE}](?=[{SPACE}])")

    def __call__(self, text: str, piece: int = PIECE) -> list[int]:
        if len(text) <= piece:
            return self.tokens.fullmatch(text).ends(1)
        ends, start = [], 0
        while start < len(text):
            edge = self.edge.search(text, start + piece)
            stop = edge.end() if edge else len(text)
            ends += self.tokens.fullmatch(text, start, stop).ends(1)
            start = stop
        return ends


def draws(key: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the key; a null key is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in (0, 8, 16, 24)]


def transformed(text: str, key: int | None, rule: Rule, ends_of: TokenEnds) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, code points of the prefix, of the middle, output) of one text."""
    ends = ends_of(text)
    n = len(ends)
    first, second, chosen, order = draws(key, rule.seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or chosen % 100 >= rule.rate:
        return n, PLAIN, None, None, text
    low, high = (ends[cut - 1] if cut else 0 for cut in sorted((first % (n + 1), second % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if order % 100 < rule.spm:
        return n, SPM, low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(documents: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of each row, where it is read, with no shuffle.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); plain output is the text, and its cuts are null. A
    null text is an empty one and plain; texts that hold a mark are plain, so :func:`restored` is exact. Keys are taken as
    long; a null key stays null and is hashed as nothing. Repeated rows are each transformed, equally. Other columns are
    not read; an empty table gives no rows. The longest text bounds the memory.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_of = TokenEnds()
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                keys = batch.column(0).slice(first, len(texts))
                found = zip(*(transformed(x, k, rule, ends_of) for x, k in zip(texts.to_pylist(), keys.to_pylist(), strict=True)), strict=True)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.array(x, kind) for x, kind in zip(found, types, strict=True))],
                    names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    frame = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    done = frame.mapInArrow(transform, "key long, n long, form string, prefix_chars long, middle_chars long, output string")
    return done.withColumnRenamed("key", spare(done.drop("key"), key))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda at: F.element_at(parts, at)
    return F.when(form == PSM, F.concat(part(2), part(4), part(3))).when(form == SPM, F.concat(part(3), part(4), part(2))).otherwise(output)
