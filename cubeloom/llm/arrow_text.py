"""Text columns as the byte buffers that Arrow holds them in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n + 1 offsets from 0, bytes) of a string column; a null text is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case; bytes of other characters stay."""
    return data + ((data - np.uint8(65)) < 26) * np.uint8(32)
