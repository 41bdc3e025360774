"""Word shingles of whole texts as sorted 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as bytes of UTF-8; each is hashed to 128 bits by XXH3, whatever
its length. Shingles are made of the first 64 bits, and a second hash of each of the others. A text of fewer words than
a shingle has one shingle, all its words; a null text or one without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix64

WORDS = 5
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words = words
        self.powers = [np.array([pow(base, words - 1 - i, 1 << 64) for i in range(words)], np.uint64) for base in (_BASE, _OTHER)]

    def word_hashes(self, text: bytes) -> np.ndarray:
        """Two hashes of each word."""
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, text.lower().split())), "<u8").reshape(-1, 2)  # bytes: ASCII letters and spaces

    def _sums(self, words: np.ndarray, k: int) -> np.ndarray:
        """The k-th hash of each shingle, in order."""
        words, powers = np.ascontiguousarray(words[:, k]), self.powers[k]
        n, size = len(words), self.words
        if n < size:  # the count keeps a short sequence apart from longer ones
            return mix64(np.array([(words * powers[size - n :]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        sums = words[: n - size + 1] * powers[0]
        for i in range(1, size):
            sums += words[i : n - size + 1 + i] * powers[i]
        return mix64(sums)

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = self.word_hashes(text or b"")
        if not len(words):
            return np.zeros(0, np.uint64)
        sums = np.sort(self._sums(words, 0))
        return sums[np.r_[True, sums[1:] != sums[:-1]]]

    def both(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The same, and the second hash of each."""
        words = self.word_hashes(text or b"")
        if not len(words):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        sums = self._sums(words, 0)
        order = np.argsort(sums)
        sums = sums[order]
        first = np.r_[True, sums[1:] != sums[:-1]]
        return sums[first], self._sums(words, 1)[order[first]]
