"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker makes Python objects of at a time.
TEXT_BYTES = 1 << 20


def by_text(batch: pa.RecordBatch, column: int, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts take ``size`` bytes at most, or one row; nothing is copied."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b
