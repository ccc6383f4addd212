"""The runs of one text in numpy: many patterns, positions or occurrences are followed at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Symbols are bytes; keys of symbol and position put runs in order of both.
SYMBOLS = 256


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class RunIndex:
    """sym, head, size, head_sa of the runs in order; sampled: which heads keep their sample; tail_sa where tails are kept; blocks sorted by start."""

    sym: np.ndarray
    head: np.ndarray
    size: np.ndarray
    head_sa: np.ndarray
    sampled: np.ndarray
    starts: np.ndarray = field(default_factory=_none)
    diffs: np.ndarray = field(default_factory=_none)
    areas: np.ndarray = field(default_factory=_none)
    tail_sa: np.ndarray | None = None

    def __post_init__(self):
        self.n = int(self.size.sum())
        self.order = np.lexsort((self.head, self.sym))  # runs by symbol, then position
        self.keys = self.sym[self.order].astype(np.int64) * (self.n + 1) + self.head[self.order]
        sizes = self.size[self.order]
        self.ahead = np.cumsum(sizes) - sizes  # symbols that are smaller, or equal and in an earlier run
        self.freq = np.bincount(self.sym, self.size, SYMBOLS).astype(np.int64)
        self.low = np.cumsum(self.freq) - self.freq

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i."""
        k = np.searchsorted(self.keys, c * (self.n + 1) + i) - 1
        run = self.order[np.maximum(k, 0)]
        there = (k >= 0) & (self.sym[run] == c)
        return np.where(there, self.ahead[np.maximum(k, 0)] - self.low[c] + np.minimum(i - self.head[run], self.size[run]), 0)

    def run_at(self, i: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.head, i, "right") - 1

    def lf(self, i: np.ndarray) -> np.ndarray:
        c = self.sym[self.run_at(i)].astype(np.int64)
        return self.low[c] + self.rank(c, i)

    def search(self, patterns: list[bytes], last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The places in patterns of those that occur, with l, r and SA[l] (or, if last, SA[r]) of the suffixes that begin with them.

        All are extended to the left by one symbol at a time; those that don't occur drop out. Whenever the interval's
        end isn't within a run of the symbol, the text position there is that of the symbol's next head (or last tail).
        """
        if not all(patterns):
            raise ValueError("empty pattern")
        size = np.array([len(p) for p in patterns], np.int64)
        flat = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64)
        stop = np.cumsum(size)
        live, l, r = np.arange(len(patterns)), np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n - 1, np.int64)
        run, step = np.full(len(patterns), -1, np.int64), np.zeros(len(patterns), np.int64)
        done = []
        for j in range(int(size.max(initial=0))):
            c = flat[stop[live] - 1 - j]
            a, b = self.rank(c, l), self.rank(c, r + 1)
            end = r if last else l
            at = self.run_at(end)
            edge = self.head[at] + self.size[at] - 1 if last else self.head[at]
            fresh = (self.sym[at] != c) | (edge == end)
            key = c * (self.n + 1) + end
            near = np.searchsorted(self.keys, key, "right") - 1 if last else np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            run, step = np.where(fresh, self.order[np.maximum(near, 0)], run), np.where(fresh, j, step)
            l, r = self.low[c] + a, self.low[c] + b - 1
            on = a < b
            live, l, r, run, step = live[on], l[on], r[on], run[on], step[on]
            full = size[live] == j + 1
            if full.any():
                done.append((live[full], l[full], r[full], run[full], step[full]))
                live, l, r, run, step = live[~full], l[~full], r[~full], run[~full], step[~full]
            if not len(live):
                break
        if not done:
            return _none(), _none(), _none(), _none()
        live, l, r, run, step = (np.concatenate(x) for x in zip(*done, strict=True))
        known = run >= 0
        at = np.maximum(run, 0)
        value = np.zeros(len(live), np.int64)
        if last:
            value = self.tail_sa[at]
        else:
            value[known] = self.decode(self.head[at[known]])
        back = size[live] - step  # symbols put in front since then, that one included
        where = (value - back) % self.n
        if not known.all():  # every step stayed inside a run of its symbol: walk from the interval itself
            where[~known] = self.decode((r if last else l)[~known])
        order = np.argsort(live, kind="stable")
        return live[order], l[order], r[order], where[order]

    def decode(self, i: np.ndarray) -> np.ndarray:
        """SA[i]: step back through the text to a sampled head, and add the steps."""
        out, left, at = np.zeros(len(i), np.int64), np.arange(len(i)), np.asarray(i, np.int64)
        steps = 0
        while len(left):
            run = self.run_at(at)
            there = (self.head[run] == at) & self.sampled[run]
            out[left[there]] = (self.head_sa[run[there]] + steps) % self.n
            left, at = left[~there], self.lf(at[~there])
            steps += 1
        return out

    def next_positions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """SA[j + 1] for x = SA[j], and whether the blocks can tell."""
        if not len(self.starts):
            return x, np.zeros(len(x), bool)
        k = np.searchsorted(self.starts, x, "right") - 1
        at = np.maximum(k, 0)
        return x + self.diffs[at], (k >= 0) & ((self.areas[at] == 0) | (x - self.starts[at] < self.areas[at]))

    def complete(self, down: bool = False) -> RunIndex:
        """This index with blocks made of all head and tail samples, which are always valid; down: for SA[j - 1] instead."""
        here, there = (self.head_sa[1:], self.tail_sa[:-1]) if down else (self.tail_sa[:-1], self.head_sa[1:])
        order = np.argsort(here)
        self.starts, self.diffs, self.areas = here[order], (there - here)[order], np.zeros(len(here), np.int64)
        return self

    def locate(self, patterns: list[bytes], strategy: str = "blocks") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the pattern, ord (from 0, in suffix-array order), and position, for each occurrence.

        samples: each occurrence is decoded by itself. blocks: from one occurrence to the next by the blocks, and by
        decoding where no block is valid. phi: by blocks alone. down: the same from the last occurrence to the first.
        """
        found, l, r, x = self.search(patterns, strategy == "down")
        count = r - l + 1
        if strategy == "samples":
            which = np.repeat(np.arange(len(found)), count)
            ord_ = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            return found[which], ord_, self.decode(l[which] + ord_) if len(which) else _none()
        out, live, k = [(found, np.zeros(len(found), np.int64), x)], np.flatnonzero(count > 1), 1
        x = x[live]
        while len(live):
            x, known = self.next_positions(x)
            if not known.all():
                if strategy != "blocks":
                    raise ValueError("the samples don't tell: this index keeps some of them only")
                x = x.copy()
                x[~known] = self.decode(l[live[~known]] + k)
            out.append((found[live], np.full(len(live), k), x))
            k += 1
            on = count[live] > k
            live, x = live[on], x[on]
        which, ord_, pos = (np.concatenate(c) for c in zip(*out, strict=True))
        if strategy == "down":
            most = np.zeros(len(patterns), np.int64)
            most[found] = count
            ord_ = most[which] - 1 - ord_
        return which, ord_, pos
