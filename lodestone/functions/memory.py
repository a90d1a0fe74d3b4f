"""What Python workers hold of a batch, and give back."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python objects at a time.
SLICE_BYTES = 1 << 20
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # no such function in this C library
    _trim = None


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of some `most` bytes of text, or of one row with more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return freed memory to the system: workers are kept, and what one batch took would lie beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
