"""Readers and writers of the usual file formats of pattern sets, run-length transforms and samples.

Readers take any path that Spark reads. Files of these formats are single; the tables they turn into aren't.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import run_length

#: Bytes of a packed sample, and of symbol and length in a run-length file by default.
SAMPLE_BYTES, SYMBOL_BYTES, LENGTH_BYTES = 5, 1, 5
HEADER = re.compile(rb"# number=(\d+) length=(\d+) file=(.*?) forbidden=(\d*)\n")
ROWS = 1 << 16


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_file(spark: SparkSession, path: str, parts) -> None:
    """Writes byte strings to one file, wherever Spark's file systems reach."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()


def _batches(columns: dict[str, np.ndarray]):
    size = len(next(iter(columns.values())))
    for a in range(0, size, ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + ROWS]) for x in columns.values()], names=list(columns))


def _decoded(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    def read(batches):
        for b in batches:
            for content in b.column(1):
                yield from _batches(decode(content.as_py()))

    return _files(spark, path).mapInArrow(read, schema)


def _numbers(data: bytes, width: int) -> np.ndarray:
    """Little-endian numbers of width bytes."""
    if len(data) % width:
        raise ValueError(f"{len(data)} bytes aren't numbers of {width}")
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.view("<i8").ravel()


def _packed(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(np.asarray(values, "<i8")[:, None].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def read_plain_bwt(spark: SparkSession, path: str) -> DataFrame:
    """i, sym of a file with one byte per symbol."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        return {"i": np.arange(len(data)), "sym": np.frombuffer(data, np.uint8).astype(np.int16)}

    return _decoded(spark, path, decode, "i bigint, sym smallint")


def read_rle_bwt(spark: SparkSession, path: str) -> DataFrame:
    """run_id, sym, len, head_i of a file with two 8-byte widths, then symbol and length of each run."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        sb, fb = (int.from_bytes(data[k : k + 8], "little") for k in (0, 8))
        if not (0 < sb <= 8 and 0 < fb <= 8) or (len(data) - 16) % (sb + fb):
            raise ValueError("not a run-length file")
        body = np.frombuffer(data, np.uint8, offset=16).reshape(-1, sb + fb)
        sym, size = _numbers(body[:, :sb].tobytes(), sb), _numbers(body[:, sb:].tobytes(), fb)
        return {"run_id": np.arange(len(sym)), "sym": sym, "len": size, "head_i": np.cumsum(size) - size}

    return _decoded(spark, path, decode, "run_id bigint, sym bigint, len bigint, head_i bigint")


def write_rle_bwt(runs: DataFrame, path: str, symbol_bytes: int = SYMBOL_BYTES, length_bytes: int = LENGTH_BYTES) -> None:
    """Writes runs (run_id, sym, len) in the order of run_id, part by part."""

    def parts():
        yield symbol_bytes.to_bytes(8, "little") + length_bytes.to_bytes(8, "little")
        for r in runs.select("sym", "len", "run_id").orderBy("run_id").toLocalIterator():
            if r.len >> 8 * length_bytes or r.sym >> 8 * symbol_bytes:
                raise ValueError(f"run {r.run_id} doesn't fit")
            yield int(r.sym).to_bytes(symbol_bytes, "little") + int(r.len).to_bytes(length_bytes, "little")

    write_file(runs.sparkSession, path, parts())


def plain_to_rle(plain: DataFrame) -> DataFrame:
    """run_id, sym, head_i, len from i, sym of one text."""
    return run_length(plain.withColumn("text_id", F.lit(0).cast("bigint"))).drop("text_id")


BWT_FORMATS = {"plain": lambda spark, path: plain_to_rle(read_plain_bwt(spark, path)), "rle": read_rle_bwt}


def read_bwt(spark: SparkSession, path: str, form: str) -> DataFrame:
    """The runs of a transform in a named format; an unknown name is an error."""
    if form not in BWT_FORMATS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(BWT_FORMATS)}")
    return BWT_FORMATS[form](spark, path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """run_id, sample from pairs of packed numbers, of which the second is the sample."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        values = _numbers(data, SAMPLE_BYTES)
        if len(values) % 2:
            raise ValueError("an odd number of samples")
        return {"run_id": np.arange(len(values) // 2), "sample": values[1::2]}

    return _decoded(spark, path, decode, "run_id bigint, sample bigint")


def write_samples(samples: DataFrame, path: str) -> None:
    """Writes samples (run_id, sample) as pairs of packed numbers, run_id first."""
    rows = samples.select("run_id", "sample").orderBy("run_id").toLocalIterator()
    write_file(samples.sparkSession, path, (_packed(np.array([r.run_id, r.sample]), SAMPLE_BYTES) for r in rows))


def read_collection_samples(spark: SparkSession, path: str) -> DataFrame:
    """run_id, head_sa, tail_sa from 8-byte numbers, head and tail by turns."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        values = _numbers(data, 8).reshape(-1, 2)
        return {"run_id": np.arange(len(values)), "head_sa": values[:, 0], "tail_sa": values[:, 1]}

    return _decoded(spark, path, decode, "run_id bigint, head_sa bigint, tail_sa bigint")


def read_string_ranges(spark: SparkSession, path: str) -> DataFrame:
    """text_id, start, end from the 8-byte starts of a collection's strings and their common end."""

    def decode(data: bytes) -> dict[str, np.ndarray]:
        values = _numbers(data, 8)
        return {"text_id": np.arange(max(0, len(values) - 1)), "start": values[:-1], "end": values[1:]}

    return _decoded(spark, path, decode, "text_id bigint, start bigint, end bigint")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pat_id, pattern from a header line and patterns of one length without anything between."""

    def read(batches):
        for b in batches:
            for content in b.column(1):
                data = content.as_py()
                m = HEADER.match(data)
                if not m:
                    raise ValueError("not a pattern file: no header")
                number, length = int(m[1]), int(m[2])
                body = data[m.end() :]
                if len(body) < number * length:
                    raise ValueError(f"{number} patterns of {length} bytes announced, {len(body)} bytes there")
                for a in range(0, number, ROWS):
                    ids = range(a, min(number, a + ROWS))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([body[k * length : (k + 1) * length] for k in ids], pa.binary())], names=["pat_id", "pattern"])

    return _files(spark, path).mapInArrow(read, "pat_id bigint, pattern binary")


def write_patterns(patterns: DataFrame, path: str, source: str = "-", forbidden: int | None = None) -> None:
    """Writes patterns (pat_id, pattern) of one length in the order of pat_id."""
    shape = patterns.agg(F.count("*").alias("n"), F.min(F.octet_length("pattern")).alias("lo"), F.max(F.octet_length("pattern")).alias("hi")).first()
    if shape.lo != shape.hi:
        raise ValueError("patterns of different lengths")

    def parts():
        yield f"# number={shape.n} length={shape.lo or 0} file={source} forbidden={'' if forbidden is None else forbidden}\n".encode()
        for r in patterns.select("pat_id", "pattern").orderBy("pat_id").toLocalIterator():
            yield r.pattern

    write_file(patterns.sparkSession, path, parts())
