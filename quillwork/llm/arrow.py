"""Texts of Arrow batches as bytes, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 2 << 20


def texts(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, UTF-8 texts) of consecutive rows, up to about ``slice_bytes`` or a single longer text."""
    column = column.cast(pa.large_binary())
    lengths = pa.compute.binary_length(column).to_pylist()
    first = size = 0
    for row, length in enumerate(lengths):
        if size and size + (length or 0) > slice_bytes:
            yield first, column[first:row].to_pylist()
            first, size = row, 0
        size += length or 0
    if first < len(lengths):
        yield first, column[first:].to_pylist()


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])
