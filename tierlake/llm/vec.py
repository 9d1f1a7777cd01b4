"""Texts in bulk: the code points of many texts in one array, and hashes of runs of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Code points that are worked on at once; bounds the memory of a worker (about 100 bytes each) save for longer single texts.
CHUNK = 400_000
_U = np.uint64


def rows(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with the texts (the last column) of each, null as empty, of about ``limit`` code points."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        lo = size = 0
        for k, t in enumerate(texts):
            size += len(t) + 1
            if size >= limit:
                yield batch.slice(lo, k + 1 - lo), texts[lo : k + 1]
                lo, size = k + 1, 0
        if lo < len(texts):
            yield batch.slice(lo), texts[lo:]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each followed by a NUL; the places of those NULs)."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_PLACES = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) | _U(1)
_BYTE = mix(np.arange(1001, 1257, dtype=np.uint64))


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``values``; run i goes from starts[i] to the next start or the end."""
    if not len(starts):
        return np.zeros(0, _U)
    ends = np.append(starts[1:], len(values))
    place = np.arange(len(values)) - np.repeat(starts, ends - starts)
    spread = _BYTE[values] if values.dtype == np.uint8 else (values.astype(_U) + _U(77)) * _U(0x9E3779B97F4A7C15)
    if spread is not None and values.dtype != np.uint8:
        spread ^= spread >> _U(29)
    h = np.add.reduceat(spread * _PLACES[place & 0xFFFF], starts)
    return mix(h + (ends - starts).astype(_U))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def owner(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of the text that each place is in."""
    return np.searchsorted(ends, places, "left")
