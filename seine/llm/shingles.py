"""Sets of hashed word shingles of whole texts, for Python workers."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
_S = np.uint64(29)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Words are runs of bytes other than ASCII white space, with A-Z lowered. A text of fewer than k words, but with
    some, has one shingle: the whole sequence. Shingles are 64-bit hashes."""

    def __init__(self, k: int, most: int = 300_000):
        self.k, self.most, self.known = k, most, _Hashes()

    def words(self, text: str | None) -> np.ndarray:
        """64-bit hashes of the words in order."""
        if len(self.known) > self.most:
            self.known = _Hashes()
        row = (text or "").encode().lower().split()  # bytes: only ASCII is lowered and split at
        return np.fromiter(map(self.known.__getitem__, row), np.uint64, len(row))

    def set(self, text: str | None) -> np.ndarray:
        """Distinct shingles, ascending."""
        w = self.words(text)
        n = len(w)
        k = min(self.k, n)
        if not n:
            return w
        h = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            h = (h ^ w[j : n - k + 1 + j]) * _K[j % 2]
            h ^= h >> _S
        return np.unique(h * _K[2])


def class_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
