"""Vectorised views of Arrow string arrays: the byte buffer, row bounds, byte gathering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def bytes_and_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n+1 row offsets into them.

    Null rows count as empty. The buffers are viewed, not copied.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if column.null_count:  # a null row may own bytes in the buffer; move its start to its end
        valid = np.asarray(column.is_valid())
        if (np.diff(bounds)[~valid] > 0).any():
            keep = np.repeat(valid, np.diff(bounds))
            lengths = np.where(valid, np.diff(bounds), 0)
            raw, bounds = raw[keep], np.concatenate([[0], np.cumsum(lengths)])
    return raw, bounds


def gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string array of the byte ranges [start, end) of ``raw``."""
    lengths = np.maximum(ends - starts, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, lengths)
    body = np.ascontiguousarray(raw[index]) if len(index) else np.zeros(0, np.uint8)
    if offsets[-1] < 2**31:
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(body))
