"""What functions over Arrow batches share."""

from __future__ import annotations

import ctypes
import gc
from functools import wraps

import pyarrow as pa


def slices(sizes: list[int], most: int, rows: int = 1 << 30):
    """(begin, end) of consecutive runs of at most `most` in total, one element at least and `rows` at most."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > most or i - begin >= rows):
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with this C library
        return


def lean(run):
    """A function over Arrow batches that gives its task's memory back at the end, as workers live on."""

    @wraps(run)
    def inner(batches, *args, **kwargs):
        yield from run(batches, *args, **kwargs)
        trim()

    return inner
