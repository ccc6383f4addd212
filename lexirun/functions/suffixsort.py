"""Suffix arrays of single texts with numpy, and what a transform tells without the text."""

from __future__ import annotations

import numpy as np


def suffix_array(data: bytes) -> np.ndarray:
    """The starts of the suffixes of data in order, by prefix doubling; a suffix is below those it begins."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    _, rank = np.unique(np.frombuffer(data, np.uint8), return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] if width < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = fresh
        if rank[order[-1]] == n:
            return order
        width *= 2


def suffix_array_by_sorting(data: bytes) -> np.ndarray:
    """The same by comparing the suffixes themselves: quick on short texts without long repeats."""
    return np.array(sorted(range(len(data)), key=lambda k: data[k:]), np.int64)


#: The sorters by name.
SORTERS = {"doubling": suffix_array, "comparing": suffix_array_by_sorting}


def run_starts(symbols: np.ndarray) -> np.ndarray:
    """Where runs of equal symbols begin."""
    return np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if len(symbols) else np.zeros(0, np.int64)


def from_transform(symbols: np.ndarray) -> np.ndarray:
    """The suffix array that belongs to a transform of one text whose terminator is its smallest symbol.

    The j-th occurrence of a symbol in the transform is the j-th in the first column, which tells for each suffix
    the next one in the text; how far it is to the end of that chain is found for all at once, by doubling.
    """
    n = len(symbols)
    after = np.argsort(symbols, kind="stable")  # the rank of the suffix one further on; that of the first row's is the whole text's
    if n and (symbols == symbols[after[0]]).sum() != 1:
        raise ValueError("not the transform of one text: its smallest symbol isn't single")
    left = np.ones(n, np.int64)  # steps to the terminator's suffix, which is the first row
    if n:
        after[0], left[0] = 0, 0
    span = 1
    while span < n:
        left += left[after]
        after = after[after]
        span *= 2
    if n and (after != 0).any():
        raise ValueError("not the transform of one text: it falls into several circles")
    return n - 1 - left
