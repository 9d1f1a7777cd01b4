"""Sampled k-mers of texts: every run of SPAN characters that two texts share holds one that both have sampled."""

from __future__ import annotations

import numpy as np

from tierlake.llm import vec

#: Length of a shared run that must be found, of a k-mer, and number of successive k-mers of which one at least is sampled.
SPAN = 300
K, WINDOW = 151, 150
_BASE = 0x9E3779B97F4A7C15 | 1
_BITS = 22
_LOW = np.uint64((1 << _BITS) - 1)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 19)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers.append(np.multiply.accumulate(factors))
    return _powers[0][:n], _powers[1][:n]


def window_hashes(cp: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` code points, by its first place; equal runs have equal hashes."""
    if len(cp) < size:
        return np.zeros(0, np.uint64)
    up, down = powers(len(cp))
    value = (cp.astype(np.uint64) + np.uint64(77)) * np.uint64(0xC2B2AE3D27D4EB4F)
    value ^= value >> np.uint64(31)
    value *= up
    total = np.empty(len(cp) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    h = total[size:] - total[:-size]
    h *= down[: len(h)]
    return vec.mix(h)


def sampled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place in it, hash) of the sampled k-mers, in order; texts shorter than SPAN have none.

    Sampled is the least k-mer of each WINDOW successive ones, the first of equal ones; of neighbours with equal hash
    (periodic text) only the first stays.
    """
    cp, ends = vec.points(texts)
    n = len(cp)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, np.zeros(0, np.uint64)
    h = window_hashes(cp, K)
    place = np.arange(len(h), dtype=np.uint64)
    least = (h & ~_LOW) | (place & _LOW)
    size = 1
    while size * 2 <= WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (WINDOW - size)], least[WINDOW - size :])
    starts = np.append(0, ends[:-1] + 1)
    to_end = np.repeat(ends, ends - starts + 1)[: len(least)] - np.arange(len(least))
    valid = np.flatnonzero(to_end >= SPAN)
    if not len(valid):
        return none, none, np.zeros(0, np.uint64)
    at = valid + ((least[valid] - valid.astype(np.uint64)) & _LOW).astype(np.int64)
    at = at[np.append(True, np.diff(at) != 0)]
    text, picked = vec.owner(at, ends), h[at]
    new = np.ones(len(at), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (text[1:] != text[:-1])
    at, text, picked = at[new], text[new], picked[new]
    return text, at - starts[text], picked
