"""What Python workers and batches hold. Workers are kept for later tasks, and their memory with them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of a batch that goes to a task's Python or comes from it, about; one row can be larger.
BATCH = 2 << 20

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return freed memory to the system: Arrow's, and numpy's where the C library can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Run) -> Run:
    """``run`` for mapInArrow with the same rows, in batches of about BATCH bytes; what it freed is given back when it ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                n = max(1, batch.num_rows * BATCH // max(batch.nbytes, 1))
                for at in range(0, batch.num_rows, n):
                    yield batch.slice(at, n)
        finally:
            batch = None
            give_back()

    return task
