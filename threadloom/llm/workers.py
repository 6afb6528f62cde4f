"""What a Python worker keeps from task to task: one operator's tables, of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

T = TypeVar("T")

#: Bytes of text that are worked on together.
BLOCK = 2 << 20

_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gave for ``key`` in this worker; anything that was kept for another key is let go."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
    return _held[key]  # type: ignore[return-value]


def release() -> None:
    """Gives memory that is free in this process back to the machine."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def blocks(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of about BLOCK bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(size, dtype=np.int64) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def parts(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The blocks of all batches of a task; free memory is given back when it ends."""
    for batch in batches:
        yield from blocks(batch, column)
    release()
