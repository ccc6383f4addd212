"""Two plans for locating patterns without an index, and the choice between them.

scan: the patterns go to every task, which reads each text once, whatever their lengths and number (functions.matcher);
the corpus isn't shuffled. For batches of up to SCAN_BYTES of patterns.
seeds: for more. Patterns have a seed, their first 1, 2, 4 ... or 32 bytes, and a filter of bounded size tells each
task which windows of its texts may be one; only these windows, as hash, text and place, meet the patterns in a
shuffle, and what does meet is compared in full with the text, which is shuffled once.

A null pattern occurs nowhere; an empty one is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matcher
from ..functions.matcher import FILTER_BITS, Matcher, passing, seed_hashes, seed_width
from .store import spread_join, written

SCAN_BYTES = 16 << 20
#: The most bits of the filter of seeds, bits in a chunk of it, and rows that leave a task at a time.
FILTER_MOST, FILTER_CHUNK, ROWS = 1 << 28, matcher.FILTER_LEAST, 1 << 16


def choose(patterns: DataFrame) -> str:
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern") + 8), F.lit(0))).first()[0]
    return "scan" if size <= SCAN_BYTES else "seeds"


def refuse_empty(patterns: DataFrame) -> DataFrame:
    """patterns without null ones; an empty one raises an error when it is read."""
    empty = F.raise_error(F.lit("empty pattern")).cast("binary")
    return patterns.filter("pattern is not null").withColumn("pattern", F.when(F.octet_length("pattern") == 0, empty).otherwise(F.col("pattern")))


def texts_of(corpus: DataFrame) -> DataFrame:
    """text_id, bytes; a row without id is no text."""
    return corpus.filter("text_id is not null").select("text_id", "bytes")


def asked_of(patterns: DataFrame) -> dict[bytes, list[int]]:
    """The distinct patterns, each with its ids: a batch of a size that is safe to send to every task."""
    if choose(patterns) != "scan":
        raise ValueError(f"over {SCAN_BYTES >> 20} MB of patterns: ask by seeds, or in several batches")
    asked: dict[bytes, list[int]] = {}
    for r in patterns.select("pat_id", "pattern").filter("pattern is not null").collect():
        if not r.pattern:
            raise ValueError("empty pattern")
        asked.setdefault(bytes(r.pattern), []).append(r.pat_id)
    return asked


def scan(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(asked_of(patterns))

    def scanned(batches):
        search, ids = Matcher(list(shared.value)), list(shared.value.values())
        times = np.array([len(x) for x in ids], np.int64)
        flat = np.array([p for x in ids for p in x], np.int64)
        start = np.cumsum(times) - times
        for b in batches:
            for text_id, data in zip(b.column(0), b.column(1), strict=True):
                which, where = search.find(data.as_py() or b"")
                n = times[which]
                pats = flat[np.repeat(start[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                where = np.repeat(where, n)
                for k in range(0, len(pats), ROWS):
                    part = slice(k, k + ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(pats[part]), pa.array(np.full(len(pats[part]), text_id.as_py(), np.int64)), pa.array(where[part])], names=["pat_id", "text_id", "pos"])

    return texts_of(corpus).mapInArrow(scanned, "pat_id bigint, text_id bigint, pos bigint")


def scan_counts(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, n: how often the distinct patterns occur; tasks send their sums only."""
    shared = corpus.sparkSession.sparkContext.broadcast(list(asked_of(patterns)))

    def counted(batches):
        search = Matcher(shared.value)
        total = np.zeros(len(search.patterns), np.int64)
        for b in batches:
            for data in b.column(0):
                total += np.bincount(search.find(data.as_py() or b"")[0], minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([search.patterns[k] for k in met], pa.binary()), pa.array(total[met])], names=["pattern", "n"])

    return texts_of(corpus).select("bytes").mapInArrow(counted, "pattern binary, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))


def _seeded(patterns: DataFrame) -> DataFrame:
    """seed (a hash), width, and the columns of patterns."""

    def seeded(batches):
        for b in batches:
            data = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(seed_hashes(data).view(np.int64)), pa.array([seed_width(len(p)) for p in data], pa.int32()), *b.columns], names=["seed", "width", *b.schema.names])

    kind = patterns.schema["pat_id"].dataType.simpleString()
    return patterns.select("pat_id", "pattern").mapInArrow(seeded, f"seed bigint, width int, pat_id {kind}, pattern binary")


def _filter_of(seeded: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit for each seed, put together by the executors, and the widths there are."""
    number, widths = seeded.agg(F.count("*"), F.collect_set("width")).first()
    size = FILTER_CHUNK
    while size < min(FILTER_MOST, number * FILTER_BITS):
        size *= 2
    place = F.col("seed").bitwiseAND(F.lit(size - 1))

    def merged(batches):
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(1).to_numpy()
            for k in np.unique(at // FILTER_CHUNK).tolist():
                bits = chunks.setdefault(k, np.zeros(FILTER_CHUNK, bool))
                bits[at[at // FILTER_CHUNK == k] % FILTER_CHUNK] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([np.packbits(x).tobytes() for x in chunks.values()], pa.binary())], names=["chunk", "bits"])

    places = seeded.select(place.alias("place")).distinct().select(F.floor(F.col("place") / FILTER_CHUNK).cast("int").alias("chunk"), "place")
    out = np.zeros(size // 8, np.uint8)
    for k, bits in places.repartition("chunk").mapInArrow(merged, "chunk int, bits binary").collect():
        out[k * FILTER_CHUNK // 8 : (k + 1) * FILTER_CHUNK // 8] |= np.frombuffer(bytes(bits), np.uint8)
    return out, sorted(widths)


def seed_windows(corpus: DataFrame, seeded: DataFrame) -> DataFrame:
    """seed, text_id, pos of the windows of corpus that pass the filter of seeds."""
    shared = corpus.sparkSession.sparkContext.broadcast(_filter_of(seeded))

    def windows(batches):
        bits, widths = shared.value
        for b in batches:
            for text_id, data in zip(b.column(0), b.column(1), strict=True):
                for _, places, hashes in passing(np.frombuffer(data.as_py() or b"", np.uint8), widths, bits):
                    for k in range(0, len(places), ROWS):
                        part = slice(k, k + ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array(hashes[part].view(np.int64)), pa.array(np.full(len(places[part]), text_id.as_py(), np.int64)), pa.array(places[part])], names=["seed", "text_id", "pos"])

    return texts_of(corpus).mapInArrow(windows, "seed bigint, text_id bigint, pos bigint")


def seed_hits(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """pat_id, pattern, text_id, pos: one row per occurrence."""
    seeded = written(_seeded(refuse_empty(patterns.select("pat_id", "pattern"))))
    near = written(spread_join(written(seed_windows(corpus, seeded)), seeded.drop("width"), "seed").drop("seed"))
    met = spread_join(near, corpus.select("text_id", "bytes"), "text_id")
    return met.filter(F.expr("substring(bytes, cast(pos AS int) + 1, octet_length(pattern)) = pattern")).select("pat_id", "pattern", "text_id", "pos")


def seeds(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    return seed_hits(corpus, patterns).select("pat_id", "text_id", "pos")


def seed_counts(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, n, as scan_counts."""
    once = patterns.select(F.lit(0).cast("bigint").alias("pat_id"), "pattern").distinct()
    return seed_hits(corpus, once).groupBy("pattern").agg(F.count("*").alias("n"))


def windows_of(corpus: DataFrame, width: int) -> DataFrame:
    """text_id, pos, window: every window of width bytes."""
    places = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - width)).alias("pos")
    return corpus.filter(F.octet_length("bytes") >= width).select("text_id", "bytes", places).select("text_id", "pos", F.expr(f"substring(bytes, pos + 1, {width})").alias("window"))
