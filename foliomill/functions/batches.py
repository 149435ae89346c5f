"""Arrow batches cut where a key changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are gathered before they are worked on.
ROWS = 50_000


def changes(batch: pa.RecordBatch | pa.Table, key: list[str]) -> np.ndarray:
    """Whether each row's key differs from the row before it; nulls are alike."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for c in key:
        x = batch.column(c)
        a, b = x.slice(1), x.slice(0, max(len(x) - 1, 0))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        out[1:] |= np.asarray(differ.combine_chunks() if isinstance(differ, pa.ChunkedArray) else differ).astype(bool)
    return out


def together(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, in which rows of one key follow each other, in batches of some ``rows`` that never cut a key's rows apart."""
    held, need = [], rows
    for batch in batches:
        held.append(batch)
        n = sum(b.num_rows for b in held)
        if n < need:
            continue
        whole = pa.concat_batches(held)
        cut = int(np.flatnonzero(changes(whole, key))[-1])
        if cut:
            yield whole.slice(0, cut)
        # a long key's rows are not looked through again before they have doubled
        held, need = [whole.slice(cut)], max(rows, 2 * (n - cut))
    if held and sum(b.num_rows for b in held):
        yield pa.concat_batches(held)
