"""Python workers live on between tasks: what a task no longer uses goes back to the system."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Batches of at least so many bytes are worth the few milliseconds.
LARGE = 4 << 20


def release() -> None:
    """Give back the memory that Arrow and the C library hold without using it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def lean(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: releases memory after each large batch and at the end of a task that had any."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch], **more) -> Iterator[pa.RecordBatch]:
        seen = 0

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            for batch in batches:
                large = batch.nbytes >= LARGE
                seen += large
                yield batch
                del batch
                if large:
                    release()

        yield from f(watched(), **more)
        if seen:
            release()

    return run
