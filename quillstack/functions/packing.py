"""Numbers and bytes in less room, for what is shuffled or sent to all tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def planes(values: np.ndarray) -> bytes:
    """Numbers by byte instead of one by one, so that bytes which are mostly zero compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def values(body: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pressed(body: bytes) -> bytes:
    """Bytes compressed, after their number."""
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(body, asbytes=True)


def unpressed(body: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(body)[8:], int.from_bytes(body[:8], "little"), asbytes=True)
