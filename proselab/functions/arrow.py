"""Helpers inside Arrow UDFs: a batch holds thousands of whole texts, so its
rows become Python objects one at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa

#: results that are Python objects at once
ROWS = 256


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The values of an Arrow column, each made when it is asked for."""
    return (x.as_py() for x in column)


def one_by_one(kind: pa.DataType, results: Iterable) -> pa.Array:
    """Results as an Arrow array, taken from an iterator bit by bit."""
    results = iter(results)
    parts = [pa.array(part, kind) for part in iter(lambda: list(islice(results, ROWS)), [])]
    out = pa.concat_arrays(parts) if parts else pa.array([], kind)
    del parts
    trim_memory()
    return out


def trim_memory() -> None:
    """Give freed memory back to the system.  Allocators keep it for their own
    process, but an executor's workers, idle ones too, share one limit; so tasks
    call this when they end."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
