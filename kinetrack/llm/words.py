"""Vectorised word splitting and hashing over Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .tables import chunks

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
#: Bytes that a row counts besides its text, so that a chunk of short texts has a bounded number of rows.
ROW = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}

#: True for the bytes of words: all but space and 09 to 0D; and digits, letters and bytes from 80.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        found = np.multiply.accumulate(steps)
        if n > CHUNK + 1:
            return found  # of one very long text: not kept
        _powers[key] = found
    return _powers[key]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA3B195354A39B70D)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """The words of some documents: byte ranges, document number and hash of each; ``first`` has the first word of each document and the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def docs(self) -> int:
        return len(self.first) - 1


def raw_chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of consecutive rows; null texts are empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    for a, b in chunks((np.diff(offsets) + ROW).tolist(), limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of ``inside`` bytes of each document, A to Z lower-cased first."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        return Words(data, *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    w = np.zeros(n + 2, bool)
    w[1:-1] = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(w[1:-1] & (~w[:-2] | edge[:-1]))
    end = np.flatnonzero(w[1:-1] & (~w[2:] | edge[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n)[:n], out=total[1:])
    h = mix((total[end] - total[start]) * _power(_INVERSE, n)[start])
    return Words(data, start, end, h, np.searchsorted(start, offsets))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document in order, and the first of each document and the end.

    A document of fewer words has its whole sequence as one shingle; one without words has none.
    """
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], count)
    width = np.repeat(np.minimum(n, k), count)
    h = width.astype(np.uint64)
    padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    for j in range(k):
        step = padded[at + j] if len(at) else padded[:0]
        h = np.where(j < width, (h ^ step) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(0x2545F4914F6CDD1D) + (h >> np.uint64(31)), h)
    return mix(h), first


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... (count of them) of each pair, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def buckets_of(sorted_buckets: np.ndarray, home: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of each bucket that occurs, and of ``home``: the work grows with the values, not with the buckets."""
    names = np.union1d(sorted_buckets, np.array([home], np.uint64))
    yield from zip(names.tolist(), np.searchsorted(sorted_buckets, names).tolist(), np.searchsorted(sorted_buckets, names, "right").tolist(), strict=True)
