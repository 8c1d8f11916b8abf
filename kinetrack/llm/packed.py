"""Compact columns of numbers inside binary cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = "zstd"


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    raw = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T)
    used = next((k for k in range(raw.itemsize, 0, -1) if planes[k - 1].any()), 0) if len(raw) else 0
    head = np.array([len(raw)], np.int64).tobytes() + bytes([used])
    return head + (pa.compress(planes[:used].tobytes(), _CODEC, asbytes=True) if used else b"")


def unpack(raw: bytes, kind: type) -> np.ndarray:
    n, used, width = int(np.frombuffer(raw[:8], np.int64)[0]), raw[8], np.dtype(kind).itemsize
    planes = np.zeros((width, n), np.uint8)
    if used:
        planes[:used] = np.frombuffer(pa.decompress(raw[9:], n * used, _CODEC, asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as packed steps."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)
