"""Shingle sets and MinHash signatures of source texts."""

from __future__ import annotations

import numpy as np

from riskloom.llm import words as W

WORDS = 5
#: A MinHash has some independent hashings of the set, each split into PER_HASHING bins.
HASHINGS, PER_HASHING = 8, 16
BINS = HASHINGS * PER_HASHING
_STARTS = np.arange(PER_HASHING, dtype=np.uint64) << np.uint64(60)


def seeds(turn: int = 0, hashings: int = HASHINGS) -> np.ndarray:
    """Odd factors of the hashings of a turn."""
    rng = np.random.Generator(np.random.PCG64([20240511, turn]))
    return rng.integers(1, 2**63, hashings, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k consecutive ASCII words."""
    return np.unique(W.grams(W.hashes(W.ASCII_WORD.findall(text)), k))


def signature(shingles: np.ndarray, factors: np.ndarray = seeds()) -> np.ndarray:
    """uint16 labels, one per bin: the smallest hash of the bin's range. The labels of two sets agree in a bin with a
    probability equal to their similarity. With as few as 30 members one bin in seven is empty; it borrows from
    the hashing's other bins in an order fixed by its number, so that two sets borrow alike (densification)."""
    out = np.empty((len(factors), PER_HASHING), np.uint64)
    for turn, factor in enumerate(factors):
        hashed = np.sort(W.mix(shingles * factor))
        first = np.searchsorted(hashed, _STARTS)
        ends = np.append(first[1:], len(hashed))
        held = first < ends
        low = hashed[np.minimum(first, len(hashed) - 1)]
        if not held.all():
            for place in np.flatnonzero(~held):
                low[place] = low[next(b for b in _ORDER[place] if held[b])]
        out[turn] = low
    return (W.mix(out.ravel()) & np.uint64(0xFFFF)).astype(np.uint16)


def _orders() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20240511))
    return np.array([rng.permutation(PER_HASHING) for _ in range(PER_HASHING)])


_ORDER = _orders()
