"""Arrow batches in pieces of few rows, so that a Python worker's memory doesn't grow with the rows of a partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """All rows in order, at most ``rows`` at a time; what the pool still holds goes back to the machine at the end."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
