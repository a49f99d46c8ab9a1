"""What a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def released(fn: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """Give memory back to the system when a task is through.

    Workers are used again by later stages; what allocators hold for reuse would
    add up from stage to stage.
    """

    @functools.wraps(fn)
    def run(batches: Batches) -> Batches:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run
