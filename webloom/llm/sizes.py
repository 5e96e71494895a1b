"""Bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def chunks(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of characters each (at least one row)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    if sizes.sum() <= most:
        yield batch
        return
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    yield batch.slice(begin)
