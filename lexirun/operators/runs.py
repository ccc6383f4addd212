"""Runs of a Burrows-Wheeler transform, and what follows from them.

runs: text_id, run_id, sym, head_i, len, rank_before (how often sym occurs before head_i), head_sa, tail_sa.
c_table: text_id, sym, freq, c_lo (how many symbols are smaller), code (dense, in order of sym).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_length(rows: DataFrame, by: str = "text_id", at: str = "i", sym: str = "sym") -> DataFrame:
    """Maximal runs of equal symbols: by, run_id, sym, head_i, len."""
    w = Window.partitionBy(by).orderBy(at)
    starts = F.coalesce((F.col(sym) != F.lag(sym).over(w)).cast("int"), F.lit(0))
    marked = rows.withColumn("__starts", starts).withColumn("run_id", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return marked.groupBy(by, "run_id").agg(F.first(sym).alias("sym"), F.min(at).alias("head_i"), F.count("*").alias("len"))


def runs(suffixes: DataFrame) -> DataFrame:
    w = Window.partitionBy("text_id").orderBy("i")
    fresh = F.coalesce((F.col("sym") != F.lag("sym").over(w)).cast("int"), F.lit(0))
    marked = suffixes.withColumn("__new", fresh).withColumn("run_id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    found = marked.groupBy("text_id", "run_id").agg(F.first("sym").alias("sym"), F.min("i").alias("head_i"), F.count("*").alias("len"), F.min_by("pos", "i").alias("head_sa"), F.max_by("pos", "i").alias("tail_sa"))
    return with_ranks(found)


def with_ranks(found: DataFrame) -> DataFrame:
    """Runs (text_id, sym, head_i, len and others) with rank_before."""
    ahead = Window.partitionBy("text_id", "sym").orderBy("head_i").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("rank_before", F.coalesce(F.sum("len").over(ahead), F.lit(0)))


def expand(found: DataFrame) -> DataFrame:
    """The plain transform again: text_id, i, sym."""
    return found.select("text_id", F.explode(F.sequence(F.col("head_i"), F.col("head_i") + F.col("len") - 1)).alias("i"), "sym")


def split_separators(found: DataFrame, separator: int) -> DataFrame:
    """Runs of the separator cut to length 1, as an index with samples needs them; run_id is numbered anew."""
    parts = F.when(F.col("sym") == separator, F.col("len")).otherwise(F.lit(1))
    cut = found.select("text_id", "sym", "head_i", "len", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("__k"))
    one = F.col("sym") == separator
    out = cut.select("text_id", "sym", (F.col("head_i") + F.col("__k")).alias("head_i"), F.when(one, F.lit(1)).otherwise(F.col("len")).cast("bigint").alias("len"))
    return out.withColumn("run_id", (F.row_number().over(Window.partitionBy("text_id").orderBy("head_i")) - 1).cast("bigint"))


def c_table(found: DataFrame) -> DataFrame:
    freq = found.groupBy("text_id", "sym").agg(F.sum("len").alias("freq"))
    w = Window.partitionBy("text_id").orderBy("sym")
    return freq.select("text_id", "sym", "freq", F.coalesce(F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c_lo"), (F.row_number().over(w) - 1).cast("bigint").alias("code"))


def symbol_histogram(corpus: DataFrame) -> DataFrame:
    """sym, freq over all bytes of a corpus; counted in Arrow batches, so at most 256 rows leave each task."""

    def counted(batches):
        total = np.zeros(256, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256) if x.is_valid and len(x.as_buffer()) else 0
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int16)), pa.array(total[has])], names=["sym", "freq"])

    return corpus.select("bytes").mapInArrow(counted, "sym smallint, freq bigint").groupBy("sym").agg(F.sum("freq").alias("freq"))


def alphabet(histogram: DataFrame) -> DataFrame:
    """A histogram of one text with c_lo and code; it has 256 rows at most, so one task is enough."""
    w = Window.orderBy("sym")
    return histogram.select("sym", "freq", F.coalesce(F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c_lo"), (F.row_number().over(w) - 1).cast("bigint").alias("code"))


def statistics(found: DataFrame) -> DataFrame:
    """text_id, n, r, sigma, max_run, mean_run."""
    return found.groupBy("text_id").agg(F.sum("len").alias("n"), F.count("*").alias("r"), F.countDistinct("sym").alias("sigma"), F.max("len").alias("max_run"), (F.sum("len") / F.count("*")).alias("mean_run"))


def run_length_histogram(found: DataFrame) -> DataFrame:
    """How many runs have each length: len, runs."""
    return found.groupBy("len").agg(F.count("*").alias("runs"))


def blocks(found: DataFrame, size: int) -> DataFrame:
    """Runs with the blocks of size positions that they touch, for joins on the block: block, and the run's columns."""
    return found.select(F.explode(F.sequence(F.floor(F.col("head_i") / size), F.floor((F.col("head_i") + F.col("len") - 1) / size))).alias("block"), "*")
