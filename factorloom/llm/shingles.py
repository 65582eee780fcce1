"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Known words of a worker; beyond, the table of known words starts anew.
KNOWN_WORDS = 100_000

_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xBF58476D1CE4E5B9)
_THREE = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _TWO
    x = (x ^ (x >> np.uint64(27))) * _THREE
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = Words()


def shingle_sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text.

    Words are runs without white space, A-Z lower-cased. Fewer words are one shingle
    of their own kind; no words give no shingle.
    """
    # bytes.lower and bytes.split know ASCII letters and white space only
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = [len(w) for w in words]
    flat = np.fromiter((_WORDS[w] for own in words for w in own), np.uint64, sum(sizes))
    out: list[np.ndarray] = []
    if flat.size >= n:
        rolled = flat[: flat.size - n + 1].copy()
        for k in range(1, n):
            rolled = mix(rolled * _ONE + flat[k : flat.size - n + 1 + k])
    at = 0
    for size in sizes:
        if size >= n:
            out.append(np.unique(rolled[at : at + size - n + 1]))
        elif size:
            own = flat[at : at + 1].copy()
            for k in range(1, size):
                own = mix(own * _ONE + flat[at + k : at + k + 1])
            out.append(mix(own + np.array([size], np.uint64) * _THREE))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out
