"""Word shingles as 64-bit hashes, a document at a time, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
#: Odd multipliers that tell the places of a shingle apart.
PLACES = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1 for k in range(1, 17)], dtype=np.uint64)
CACHE_ENTRIES = 400_000


class WordHashes(dict):
    """Hashes of words, kept while they are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: A-Z lower-cased, words split at ASCII space.

    Fewer words than width: the whole sequence is one shingle; no words: none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for place in range(k):
        total += h[place : place + n] * PLACES[place]
    return np.unique(mix(total))
