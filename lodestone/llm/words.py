"""Words of many texts as flat arrays, and hashes of word windows, computed for a whole batch at once."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_ENTRIES = 300_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words as signed integers, remembered for about the last CACHE_ENTRIES to twice as many."""

    def __init__(self):
        self.old: dict = {}

    def __missing__(self, word: bytes) -> int:
        value = self.old.get(word)
        if value is None:
            value = xxhash.xxh3_64_intdigest(word) - 2**63
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def hashed(words: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets by document)."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    flat = np.fromiter((h for doc in words for h in map(cache.__getitem__, doc)), np.int64, int(offsets[-1]))
    return flat.view(np.uint64), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; windows that cross documents are the caller's to leave out."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= ODD
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def inside(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Starts of the windows of n words that lie in one document."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(max(0, total - n + 1))
    return at[doc[at] == doc[at + n - 1]] if len(at) else at
