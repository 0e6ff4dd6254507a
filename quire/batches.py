"""Arrow batches in runs of bounded bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a run holds.
RUN_BYTES = 4 << 20


@cache
def _trim():
    """The C library's call that gives freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


def give_back() -> None:
    """Free memory that Arrow and the C library hold on to goes back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def runs(batch: pa.RecordBatch, weigh: str | None, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``most`` bytes of the column ``weigh``, or of one row. What a slice left behind goes back to the system at the end."""
    if not weigh or batch.num_rows == 0:
        if batch.num_rows:
            yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(weigh)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)
    give_back()
