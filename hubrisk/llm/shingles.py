"""Word shingles as 64-bit numbers (numpy, inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SHIFT = np.uint64(32)


class WordHash(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes | None, limit: int = 500_000) -> np.ndarray:
        """Hashes of the words of an ASCII-lower-cased UTF-8 text. ``bytes.split`` cuts at exactly
        the six white-space bytes of the contract and ``bytes.lower`` touches A-Z only."""
        if len(self) > limit:
            self.clear()
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles; a shorter sequence counts as one. 64-bit values stand for the word
    tuples: n different shingles have a chance match with odds of n * n / 2**65."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(n, width)
    h = np.full(n - size + 1, size, np.uint64) * P1
    for k in range(size):
        h = (h ^ words[k:n - size + 1 + k]) * P2
        h ^= h >> SHIFT
        h *= P1
        h ^= h >> np.uint64(29)
    return np.unique(h)


def set_key(shingles: np.ndarray) -> bytes | None:
    """128-bit name of a set (None for the empty one)."""
    return hashlib.md5(shingles.tobytes(), usedforsecurity=False).digest() if len(shingles) else None
