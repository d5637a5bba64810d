"""Complete groups out of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, group numbers) with at least `least` rows where there are as many; rows come sorted by keys and no group is cut."""
    held: list[pa.RecordBatch] = []
    size = 0

    def numbered(t: pa.Table) -> np.ndarray:
        change = np.zeros(len(t), bool)
        for k in keys:
            c = t.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.cumsum(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        group = numbered(t)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield t.slice(0, cut), group[:cut]
            held = t.slice(cut).to_batches()
            size = len(t) - cut
        else:
            held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, numbered(t)
