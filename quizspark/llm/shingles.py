"""Word shingles of a text as sorted distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser with full avalanche."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash. Cleared when it has `most` entries, to bound memory."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, cut at the six ASCII white-space characters."""
    return text.lower().split() if text else []


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of `size`-word shingles, ascending. Fewer words: the whole sequence as one; none: empty."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, size)
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = mix((out + hashes[j : n - width + 1 + j]) * _STEP + np.uint64(1))
    return np.unique(out)
