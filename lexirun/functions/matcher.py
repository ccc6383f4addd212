"""Where any of many patterns occur in a text, by hashes of windows in numpy.

A pattern's seed is its first 1, 2, 4 ... or SEED bytes. All windows of a text of these widths are hashed at once; those
that a filter lets pass are looked up among the seeds, and what is found is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The longest seed, a power of two; windows of a text that are looked at at a time; bits of the filter for each pattern, and at least.
SEED, STRETCH, FILTER_BITS, FILTER_LEAST = 32, 1 << 20, 16, 1 << 19


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def seed_width(size: int) -> int:
    return min(SEED, 1 << (size.bit_length() - 1))


def window_hashes(data: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of widths (powers of two, rising) the hashes of all windows of data of that width: each is made of two halves."""
    h, width = _mix(data.astype(np.uint64) + np.uint64(1), 1), 1
    for asked in widths:
        while width < asked and len(h):
            h = _mix(h[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + _mix(h[width:], 2), 3) if len(h) > width else h[:0]
            width *= 2
        yield asked, _mix(h, 16 + asked)


def seed_hashes(patterns: list[bytes]) -> np.ndarray:
    """The hash of each pattern's seed, as windows of a text have it."""
    out = np.zeros(len(patterns), np.uint64)
    widths = np.array([seed_width(len(p)) for p in patterns], np.int64)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        flat = np.frombuffer(b"".join(patterns[k][:w] for k in at.tolist()), np.uint8)
        out[at] = next(h for _, h in window_hashes(flat, [w]))[::w]
    return out


def passing(text: np.ndarray, widths: list[int], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, hashes) of the windows of text whose hash has its bit, some at a time."""
    mask = np.uint64(len(bits) * 8 - 1)
    for first in range(0, len(text), STRETCH) if widths else ():
        for width, h in window_hashes(text[first : first + STRETCH + widths[-1] - 1], widths):
            h = h[:STRETCH]
            at = (h & mask).astype(np.int64)
            met = np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            if len(met):
                yield width, first + met, h[met]


class Matcher:
    """Finds distinct patterns, none empty."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        hashes = seed_hashes(patterns)
        self.widths = sorted({seed_width(len(p)) for p in patterns})
        self.order = np.argsort(hashes, kind="stable")
        self.seeds, self.first = np.unique(hashes[self.order], return_index=True)
        self.stop = np.append(self.first[1:], len(patterns))
        size = FILTER_LEAST
        while size < len(patterns) * FILTER_BITS:
            size *= 2
        marked = np.zeros(size, bool)
        marked[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
        self.bits = np.packbits(marked)

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The place in patterns and the position of each occurrence."""
        which, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, places, hashes in passing(np.frombuffer(text, np.uint8), self.widths, self.bits):
            k = np.searchsorted(self.seeds, hashes)
            k[k == len(self.seeds)] = 0
            known = self.seeds[k] == hashes
            k, places = k[known], places[known]
            times = self.stop[k] - self.first[k]
            at = np.repeat(places, times)
            p = self.order[np.repeat(self.first[k] - np.cumsum(times) + times, times) + np.arange(len(at))]
            held = self.patterns
            true = np.fromiter((text.startswith(held[x], y) for x, y in zip(p.tolist(), at.tolist(), strict=True)), bool, len(at))
            which.append(p[true])
            where.append(at[true])
        return np.concatenate(which), np.concatenate(where)
