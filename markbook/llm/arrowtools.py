"""Helpers of the operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute


def pieces(batch: pa.RecordBatch, text: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts (column ``text``) hold about ``most_bytes``; one row at least."""
    lengths = batch.column(text).cast(pa.binary())
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(lengths).to_pylist()):
        if held and held + (n or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every value, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
