"""Words and hashed word shingles of whole texts.

Words are what lies between ASCII white space, A-Z lower-cased. A text's shingles are its runs of `size`
words; with fewer words, the whole sequence is one; without words there are none.
"""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
#: Fixed odd multipliers, one for each place in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only, bytes.split() splits at space and \\t\\n\\v\\f\\r only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def hashes_of(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and without repeats (faster than np.unique)."""
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate([[True], x[1:] != x[:-1]])]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """64-bit hashes of the shingles in text order, repeats included."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=size - n)], np.uint64)
    h = hashes_of(words)
    total = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        total += h[i : n - size + 1 + i] * (PLACES[i % len(PLACES)] + np.uint64(2 * (i // len(PLACES))))
    return mix(total)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return distinct(shingles_of(words_of(text), size))
