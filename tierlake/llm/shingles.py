"""Words and word triples of texts in bulk."""

from __future__ import annotations

import numpy as np

from tierlake.llm import vec
from tierlake.llm.chars import DROP, composed, folds

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(folded letters and digits of all texts with 0 between words, the places of the ends of texts)."""
    table, slow = folds()
    cp, ends = vec.points(texts)
    hard = np.unique(vec.owner(np.flatnonzero(slow[cp]), ends)).tolist()
    if hard:
        texts = list(texts)
        for k in hard:
            texts[k] = composed(texts[k])
        cp, ends = vec.points(texts)
    fold = table[cp]
    fold[ends] = 0
    keep = fold != DROP
    if not keep.all():
        ends = np.cumsum(keep)[ends] - 1
        fold = fold[keep]
    return fold, ends


def triples(fold: np.ndarray, ends: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words within a text, number of its text), repeated ones included."""
    inside = fold != 0
    before = np.append(False, inside[:-1])
    starts = np.flatnonzero(inside & ~before)
    if len(starts) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.flatnonzero(inside)
    h = vec.run_hashes(fold[packed], np.searchsorted(packed, starts))
    text = vec.owner(starts, ends)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ h[k : n + k]) * (_A, _B, _C)[k % 3] + np.uint64(k)
    same = text[:n] == text[size - 1 :]
    return vec.mix(out[same]), text[:n][same]


def triple_sets(texts: list[str], size: int = 3) -> list[np.ndarray]:
    """The distinct hashes of word runs of each text, sorted."""
    h, text = triples(*folded(texts), size)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.split(h[first], np.searchsorted(text[first], np.arange(1, len(texts))))
