"""Word hashes shared by the text operators: 64-bit, equal on every worker and run."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Longest runs of Unicode letters and digits.
UNICODE_WORD = re.compile(r"[^\W_]+")
#: Longest runs of ASCII letters, digits and underscore.
ASCII_WORD = re.compile(r"[A-Za-z0-9_]+")
#: Words a worker remembers before it starts anew.
CACHE_ENTRIES = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = value
        return value


_hashes = _WordHash()


def hashes(words: list[str]) -> np.ndarray:
    """uint64 hash of each word."""
    if len(_hashes) > CACHE_ENTRIES:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words, in text order."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _ODD + word_hashes[i : i + n]
    return mix(out)


def spans(word_hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` consecutive words at a cost that does not grow with the length."""
    n = len(word_hashes)
    if length > n:
        return np.empty(0, np.uint64)
    # sum of h[i] * odd**i over the run, moved to the exponent 0
    powers, inverses = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64) for base in (_ODD, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word_hashes) * powers[:n], dtype=np.uint64)])
    return mix((sums[length:] - sums[: n - length + 1]) * inverses[: n - length + 1])


def lower_words(text: str) -> list[str]:
    """Unicode words in lower case; only U+0130 changes its extent when lowered, so such texts are split first."""
    if "İ" in text:
        return [w.lower() for w in UNICODE_WORD.findall(text)]
    return UNICODE_WORD.findall(text.lower())
