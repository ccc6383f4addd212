"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact verification."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_where, only_ids, packed, row_key
from .shingles import SIZE, shingles_of, words_of

BITS, BLOCKS = 64, 5
#: Fingerprints within this many bits are candidates. At weighted similarity 0.8 the mean distance is 9.7 bits, its deviation 2.9.
RADIUS = 19
PERCENT = 80
#: Items, and bytes of their texts, that go to the tasks at a time: an item takes 7 to 18 kB there for its fingerprint, and about 20 bytes a byte of text.
#: More items take more turns, over the documents that hold a shingle of any item.
ITEMS_PER_PASS, BYTES_PER_PASS = 4096, 2 << 20
#: Bits of the filter that finds these documents: FILTER_BITS for each word of the items, but not more than FILTER_MOST.
FILTER_BITS, FILTER_MOST, FILTER_CHUNK = 16, 1 << 28, 1 << 19
#: Windows whose bits are summed at a time.
STRETCH = 16_384
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprints(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the windows of length shingles that begin at starts (sorted); a shingle weighs as often as it occurs."""
    out = np.zeros(len(starts), np.uint64)
    for a in range(0, len(starts), STRETCH):
        part = starts[a : a + STRETCH]
        for piece in np.split(part, np.flatnonzero(np.diff(part) > length) + 1):
            lo, hi = piece[0], piece[-1] + length
            bits = np.unpackbits(shingles[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.zeros((hi - lo + 1, BITS), np.int32)
            np.cumsum(bits, axis=0, out=sums[1:])
            ones = sums[piece - lo + length] - sums[piece - lo]
            at = a + np.searchsorted(part, piece[0])
            out[at : at + len(piece)] = np.packbits(2 * ones > length, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _near(width: int, radius: int) -> np.ndarray:
    """All numbers of width bits with at most radius ones."""
    x = np.arange(1 << width, dtype=np.uint32)
    return x[np.bitwise_count(x) <= radius]


class MultiIndex:
    """Finds all stored fingerprints within radius: some of the blocks then differs in at most radius // blocks bits.

    A block's table has each stored value with all that are so near to it, so a lookup is one search.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius = prints, radius
        edges = [BITS * j // blocks for j in range(blocks + 1)]
        self.tables = []
        for low, high in zip(edges, edges[1:], strict=False):
            near = _near(high - low, radius // blocks)
            entries = (self._block(prints, low, high)[:, None] ^ near[None, :]).ravel()
            order = np.argsort(entries, kind="stable")
            keys, first = np.unique(entries[order], return_index=True)
            self.tables.append((low, high, keys.astype(np.uint16), np.append(first, len(order)).astype(np.int32), (order // len(near)).astype(np.int32)))

    @staticmethod
    def _block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return ((prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.uint32)

    def pairs(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place in prints, place in the index) within the radius, each once, in order."""
        found = [np.zeros(0, np.int64)]
        for low, high, keys, first, stored in self.tables:
            asked = self._block(prints, low, high).astype(np.uint16)
            place = np.searchsorted(keys, asked)
            place[place == len(keys)] = 0
            met = np.flatnonzero(keys[place] == asked) if len(keys) else np.zeros(0, np.int64)
            start, stop = first[place[met]].astype(np.int64), first[place[met] + 1].astype(np.int64)
            counts = stop - start
            left = np.repeat(met, counts)
            right = stored[np.repeat(start - np.cumsum(counts) + counts, counts) + np.arange(len(left))]
            ok = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
            found.append(left[ok] * len(self.prints) + right[ok])
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


@dataclass
class Items:
    ids: list
    lengths: np.ndarray  # in shingles
    counts: list[tuple[np.ndarray, np.ndarray]]  # distinct shingles, how often
    vocabulary: np.ndarray
    owners: list[np.ndarray]  # for each shingle of the vocabulary the items that have it
    filter: np.ndarray
    index: dict[int, tuple[np.ndarray, MultiIndex]]  # by length: the items of that length, and their fingerprints

    @staticmethod
    def of(rows: pd.DataFrame) -> Items | None:
        texts = [(i, shingles_of(words_of(t))) for i, t in zip(rows["item_id"], rows["text"], strict=True)]
        texts = [(i, s) for i, s in texts if len(s)]
        if not texts:
            return None
        lengths = np.array([len(s) for _, s in texts])
        counts = [np.unique(s, return_counts=True) for _, s in texts]
        every = np.concatenate([u for u, _ in counts])
        owner = np.repeat(np.arange(len(texts)), [len(u) for u, _ in counts])
        vocabulary, place = np.unique(every, return_inverse=True)
        order = np.argsort(place, kind="stable")
        owners = np.split(owner[order], np.cumsum(np.bincount(place))[:-1])
        known = np.zeros(1 << 22, bool)
        known[(vocabulary & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        prints = np.array([fingerprints(s, np.array([0]), len(s))[0] for _, s in texts], np.uint64)
        index = {int(n): (at, MultiIndex(prints[at])) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]}
        return Items([i for i, _ in texts], lengths, counts, vocabulary, owners, known, index)


def _windows(hits: np.ndarray, length: int, n: int) -> np.ndarray:
    """Starts of all windows of length shingles in n that hold one of hits (sorted)."""
    last = max(0, n - length)
    delta = np.zeros(last + 2, np.int32)
    np.add.at(delta, np.clip(hits - length + 1, 0, last), 1)
    np.add.at(delta, np.minimum(hits, last) + 1, -1)
    return np.flatnonzero(np.cumsum(delta[:-1]) > 0)


def matches(text: str | None, items: Items) -> list[tuple[int, int, int, int, int, int]]:
    """(item, shared, united, first word, words, windows) for each item that some window of text is like.

    A window is as long as the item, or the whole text if that is shorter. Windows without any shingle of the
    items have similarity 0, so only the others are fingerprinted; those in the radius of an item of their
    length are compared exactly: as multisets, the sum of smaller counts must be PERCENT of that of larger ones. Of
    equally good windows the first is told.
    """
    s = shingles_of(words_of(text))
    if not len(s):
        return []
    hits = np.flatnonzero(items.filter[(s & np.uint64(len(items.filter) - 1)).astype(np.int64)])
    places = np.searchsorted(items.vocabulary, s[hits])
    places[places == len(items.vocabulary)] = 0
    ok = items.vocabulary[places] == s[hits]
    hits, places = hits[ok], places[ok]
    if not len(hits):
        return []
    by_length: dict[int, list[int]] = {}
    for hit, place in zip(hits.tolist(), places.tolist(), strict=True):
        for length in {int(items.lengths[i]) for i in items.owners[place]}:
            by_length.setdefault(length, []).append(hit)
    seen = np.zeros(len(s) + 1, np.int64)
    seen[hits + 1] = 1
    np.cumsum(seen, out=seen)
    best: dict[int, tuple[int, int, int, int]] = {}
    for length, near in by_length.items():
        size = min(length, len(s))
        starts = _windows(np.array(near), size, len(s))
        of_length, index = items.index[length]
        # shared <= hits in the window, and shared >= PERCENT / (100 + PERCENT) of both sizes together
        starts = starts[(seen[starts + size] - seen[starts]) * (100 + PERCENT) >= PERCENT * (size + length)]
        found = [(part[w], of_length[i]) for k in range(0, len(starts), STRETCH) for part in [starts[k : k + STRETCH]] for w, i in [index.pairs(fingerprints(s, part, size))]]
        for a, i in ((int(a), int(i)) for begin, item in found for a, i in zip(begin, item, strict=True)):
            known, counts = items.counts[i]
            at = np.searchsorted(known, s[a : a + size])
            at[at == len(known)] = 0
            at = at[known[at] == s[a : a + size]]
            shared = int(np.minimum(np.bincount(at, minlength=len(known)), counts).sum())
            united = size + length - shared
            if 100 * shared >= PERCENT * united:
                old = best.get(i)
                n = (old[3] if old else 0) + 1
                best[i] = (shared, united, a, n) if old is None or shared * old[1] > old[0] * united else (*old[:3], n)
    return [(i, shared, united, a, min(int(items.lengths[i]), len(s)), n) for i, (shared, united, a, n) in sorted(best.items())]


SCHEMA = "item_id bigint, similarity double, start bigint, end bigint, windows bigint"


def _passes(items: DataFrame) -> int:
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, -(-rows // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS))


def _filter_of(items: DataFrame) -> np.ndarray:
    """One bit for each place that a shingle of some item has; made by the executors, in chunks, and of a bounded size."""
    words = items.agg(F.coalesce(F.sum(F.octet_length("text") / 5), F.lit(0.0))).first()[0]
    size = FILTER_CHUNK
    while size < min(FILTER_MOST, words * FILTER_BITS):
        size *= 2

    def marked(batches):
        bits = np.zeros(size, bool)
        for b in batches:
            for t in b.column(0):
                bits[(shingles_of(words_of(t.as_py())) & np.uint64(size - 1)).astype(np.int64)] = True
        parts = [(k, np.packbits(bits[a : a + FILTER_CHUNK]).tobytes()) for k, a in enumerate(range(0, size, FILTER_CHUNK)) if bits[a : a + FILTER_CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["chunk", "bits"])

    def merged(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[k] = total.get(k, 0) | np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "bits"])

    schema = "chunk int, bits binary"
    out = np.zeros(size // 8, np.uint8)
    for k, x in items.select("text").mapInArrow(marked, schema).repartition("chunk").mapInArrow(merged, schema).collect():
        out[k * FILTER_CHUNK // 8 : (k + 1) * FILTER_CHUNK // 8] = np.frombuffer(bytes(x), np.uint8)
    return out


def _meeting(docs: DataFrame, text_col: str, items: DataFrame) -> DataFrame:
    """The rows of docs that may share a shingle with some item."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(items))

    def judge():
        bits = shared.value
        mask = np.uint64(len(bits) * 8 - 1)

        def meets(text: str) -> bool:
            at = (shingles_of(words_of(text)) & mask).astype(np.int64)
            return bool((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).any())

        return meets

    return keep_where(docs, text_col, judge)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs and item (item_id, text) that a window of its text is like, see matches.

    Returns doc_id, item_id, similarity (the best window's, 0.8 at least), start and end of that window in code
    points of the text (of equally good ones the first), and windows, how many qualified. Null and empty texts and
    items match nothing; texts of any length are read whole; rows that repeat match once each; ids may be null; other
    columns are ignored, whatever their names; empty tables give an empty one. The items go to every task and the
    documents stay where they are; where the items are too many to be sent at a time, one scan finds the documents
    that share a shingle with any, and only these are read again for each part of them.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = raw.schema["doc_id"].dataType.simpleString()
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    passes = _passes(items)
    if passes > 1:
        items = cut(items)
        raw = cut(_meeting(raw, "text", items))
    out = None
    for k in range(passes):
        shared = docs.sparkSession.sparkContext.broadcast(_part(items, k, passes))

        def found(batches, shared=shared):
            known = shared.value
            names = ["doc_id", "item_id", "similarity", "start", "end", "windows"]
            for b in batches:
                ids, cols = [], [[] for _ in names[1:]]
                for doc, t in zip(b.column(0), b.column(1), strict=True):
                    text = t.as_py()
                    got = matches(text, known) if known else []
                    spans = [m.span() for m in WORD.finditer(text)] if got else []
                    for i, a, u, first, size, n in got:
                        ids.append(doc.as_py())
                        last = min(first + size + SIZE - 1, len(spans))
                        for col, value in zip(cols, (known.ids[i], a / u, spans[first][0], spans[last - 1][1], n), strict=True):
                            col.append(value)
                kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=names)

        part = raw.mapInArrow(found, f"doc_id {kind}, {SCHEMA}")
        out = part if out is None else out.unionByName(part)
    return out


def _part(items: DataFrame, k: int, passes: int) -> Items | None:
    some = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
    return Items.of(some.toPandas())


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, all columns, without the rows in whose text find_contamination finds an item, each judged by its own text.

    Rows that share an id, or have none, don't share a fate; rows with null and empty texts stay; columns may have any
    names; an empty table gives an empty one.
    """
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    if _passes(items) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_part(items, 0, 1))
        return keep_where(docs, "text", lambda: lambda text: not (shared.value and matches(text, shared.value)))
    key = row_key(F.col("doc_id"), F.col("text"))
    gone = cut(find_contamination(packed(docs, doc_id=key, text=F.col("text")), items).select("doc_id.*").distinct())
    return only_ids(packed(docs, k=key).select("row", "k.*"), gone, ["k1", "k2"], "left_anti").select("row.*")
