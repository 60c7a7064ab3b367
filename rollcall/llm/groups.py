"""Complete groups of sorted Arrow batches, a bounded number at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts): rows of complete groups by the first ``keys`` (integer) columns, which are sorted.

    A group may reach over batches; what is held at once is one batch and the group at its end.
    """
    rest: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        for k in range(keys):
            values = table.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        starts = cut(table)
        if not len(starts):
            rest = table.to_batches()
            continue
        done = table.slice(0, int(starts[-1]))
        rest = table.slice(int(starts[-1])).to_batches()
        yield done, np.concatenate([[0], starts[:-1]]).astype(np.int64)
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, np.array([0], np.int64)
