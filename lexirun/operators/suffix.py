"""Suffix arrays and Burrows-Wheeler transforms as rows: text_id, i (rank), pos (= SA[i]), sym (= BWT[i])."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.suffixsort import SORTERS, from_transform, run_starts
from .asof import asof
from .corpus import TERMINATOR, symbol_at

SUFFIXES = "text_id bigint, i bigint, pos bigint, sym smallint"
RUNS = "text_id bigint, run_id bigint, sym smallint, head_i bigint, len bigint, head_sa bigint, tail_sa bigint, rank_before bigint"
ROWS = 1 << 17


def sorted_texts(batches, sorter: str = "doubling"):
    """(text_id, text with its terminator, suffix array) of Arrow batches (text_id, bytes); rows without bytes are left out."""
    if sorter not in SORTERS:
        raise ValueError(f"unknown sorter {sorter!r}; known: {', '.join(SORTERS)}")
    for b in batches:
        for text_id, data in zip(b.column(0), b.column(1), strict=True):
            if not data.is_valid:
                continue
            text = data.as_py() + bytes([TERMINATOR])
            if TERMINATOR in text[:-1]:
                raise ValueError(f"text holds the terminator: {text_id.as_py()}")
            yield text_id.as_py(), text, SORTERS[sorter](text)


def _slices(text_id: int, **columns: np.ndarray):
    size = len(next(iter(columns.values())))
    for a in range(0, size, ROWS):
        part = {c: x[a : a + ROWS] for c, x in columns.items()}
        ids = np.full(min(ROWS, size - a), text_id, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, part.values())], names=["text_id", *part])


def suffixes(corpus: DataFrame, sorter: str = "doubling") -> DataFrame:
    """Sorted suffixes of each text with its terminator, any length; texts are sorted where they lie, without a shuffle. A text without bytes has none."""

    def sorted_rows(batches):
        for text_id, text, order in sorted_texts(batches, sorter):
            yield from _slices(text_id, i=np.arange(len(order)), pos=order, sym=np.frombuffer(text, np.uint8)[order - 1].astype(np.int16))

    return corpus.select("text_id", "bytes").mapInArrow(sorted_rows, SUFFIXES)


def run_columns(symbols: np.ndarray, order: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of the runs of a transform with its suffix array, see operators.runs."""
    head = run_starts(symbols)
    size = np.diff(np.append(head, len(symbols)))
    sym = symbols[head].astype(np.int16)
    by_symbol = np.argsort(sym, kind="stable")
    total = np.cumsum(size[by_symbol]) - size[by_symbol]
    first = np.searchsorted(sym[by_symbol], sym[by_symbol])
    before = np.empty(len(head), np.int64)
    before[by_symbol] = total - total[first]
    return {"run_id": np.arange(len(head)), "sym": sym, "head_i": head, "len": size, "head_sa": order[head], "tail_sa": order[head + size - 1], "rank_before": before}


def sorted_runs(corpus: DataFrame, sorter: str = "doubling") -> DataFrame:
    """What runs.runs(suffixes(corpus)) gives, made where the texts lie: only runs leave a task, and nothing is shuffled."""

    def runs_of(batches):
        for text_id, text, order in sorted_texts(batches, sorter):
            yield from _slices(text_id, **run_columns(np.frombuffer(text, np.uint8)[order - 1], order))

    return corpus.select("text_id", "bytes").mapInArrow(runs_of, RUNS)


def from_runs(found: DataFrame) -> DataFrame:
    """Suffixes (text_id, i, pos, sym) from runs (text_id, sym, head_i, len) of a transform alone, without its text or any sample."""

    def walked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("head_i")
        symbols = np.repeat(group["sym"].to_numpy(np.int16), group["len"])
        return pd.DataFrame({"text_id": group["text_id"].iloc[0], "i": np.arange(len(symbols)), "pos": from_transform(symbols), "sym": symbols})

    return found.select("text_id", "sym", "head_i", "len").groupBy("text_id").applyInPandas(walked, SUFFIXES)


def sampled_runs(found: DataFrame) -> DataFrame:
    """Runs (text_id, sym, head_i, len) of a transform alone with all that runs have, head_sa and tail_sa too."""

    def walked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("head_i")
        symbols = np.repeat(group["sym"].to_numpy(np.int16), group["len"])
        return pd.DataFrame({"text_id": group["text_id"].iloc[0], **run_columns(symbols, from_transform(symbols))})

    return found.select("text_id", "sym", "head_i", "len").groupBy("text_id").applyInPandas(walked, RUNS)


def suffixes_by_window(corpus: DataFrame) -> DataFrame:
    """The same in built-in functions only, for texts up to about a kilobyte: it sorts the suffixes themselves."""
    text = corpus.select("text_id", F.concat("bytes", F.lit(bytes([TERMINATOR]))).alias("t"))
    each = text.select("text_id", "t", F.explode(F.sequence(F.lit(0), F.octet_length("t") - 1)).alias("pos"))
    w = Window.partitionBy("text_id").orderBy(F.expr("substring(t, pos + 1)"))
    before = F.when(F.col("pos") == 0, F.octet_length("t") - 1).otherwise(F.col("pos") - 1)
    return each.select("text_id", (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.col("pos").cast("bigint").alias("pos"), symbol_at(F.col("t"), before).alias("sym"))


def psi(rows: DataFrame) -> DataFrame:
    """text_id, i, psi: the rank of the suffix one further on in the text; the last position is followed by the first."""
    size = rows.groupBy("text_id").agg(F.count("*").alias("size"))
    after = rows.select("text_id", F.col("pos").alias("next"), F.col("i").alias("psi"))
    here = rows.join(size, "text_id").select("text_id", "i", ((F.col("pos") + 1) % F.col("size")).alias("next"))
    return here.join(after, ["text_id", "next"]).select("text_id", "i", "psi")


def psi_runs(rows: DataFrame) -> DataFrame:
    """The runs in which psi rises by one, each within one first symbol: text_id, first (that symbol), head_i, psi (of head_i), len."""
    symbols = rows.groupBy("text_id", "sym").agg(F.count("*").alias("freq"))
    low = F.coalesce(F.sum("freq").over(Window.partitionBy("text_id").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = symbols.select("text_id", F.col("sym").alias("first"), low.alias("c_lo"))
    placed = asof(psi(rows), starts, ["text_id"], "i", "c_lo").select("text_id", "i", "psi", F.col("found.first").alias("first"))
    w = Window.partitionBy("text_id").orderBy("i")
    fresh = F.coalesce((F.col("psi") != F.lag("psi").over(w) + 1) | (F.col("first") != F.lag("first").over(w)), F.lit(True)).cast("int")
    marked = placed.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("text_id", "__run").agg(F.first("first").alias("first"), F.min("i").alias("head_i"), F.min("psi").alias("psi"), F.count("*").alias("len")).drop("__run")


def psi_lookup(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i) with psi, from runs of psi."""
    met = asof(probes, runs.select("text_id", "head_i", "psi", "len"), ["text_id"], "i", "head_i")
    f = F.col("found")
    return met.select(*probes.columns, F.when(F.col("i") < f["head_i"] + f["len"], f["psi"] + F.col("i") - f["head_i"]).alias("psi"))


def psi_range(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, sym, i, j) with l, r: the interval of what begins with sym and goes on as in [i, j], from runs of psi alone; null if empty.

    Within one first symbol psi rises, so the ends are the first place with psi >= i and the last with psi <= j.
    """
    rows = runs.select("text_id", F.col("first").alias("sym"), "head_i", "psi", "len")
    last = F.col("psi") + F.col("len") - 1
    low = asof(probes, rows.withColumn("__end", last), ["text_id", "sym"], "i", "__end", forward=True)
    f = F.col("found")
    low = low.select(*probes.columns, (f["head_i"] + F.greatest(F.col("i") - f["psi"], F.lit(0))).alias("__l"))
    both = asof(low, rows, ["text_id", "sym"], "j", "psi")
    high = f["head_i"] + F.least(F.col("j") - f["psi"], f["len"] - 1)
    some = F.coalesce(F.col("__l") <= high, F.lit(False))
    return both.select(*probes.columns, F.when(some, F.col("__l")).alias("l"), F.when(some, high).alias("r"))


def prefix_intervals(corpus: DataFrame, depth: int) -> DataFrame:
    """Intervals [l, r] of all strings of 1 to depth symbols that occur, as text_id, depth, prefix (hex), l, r.

    They are found where a text is sorted: suffixes that share so many symbols are neighbours, so only intervals leave a task.
    """

    def found(batches):
        for text_id, text, order in sorted_texts(batches):
            padded = np.frombuffer(text + bytes(depth), np.uint8)
            going = np.ones(len(order), bool)
            for k in range(depth):
                going[1:] &= padded[order[1:] + k] == padded[order[:-1] + k]
                going[0] = False
                whole = order + k + 1 < len(text)  # not over the terminator
                first = np.flatnonzero(whole & ~going)
                group = np.cumsum(~going) - 1  # intervals of the depth, also those over the terminator
                last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
                r = last[group[first]]
                prefix = [text[p : p + k + 1].hex().upper() for p in order[first].tolist()]
                columns = [pa.array(np.full(len(first), text_id, np.int64)), pa.array(np.full(len(first), k + 1, np.int32)), pa.array(prefix, pa.string()), pa.array(first), pa.array(r)]
                yield pa.RecordBatch.from_arrays(columns, names=["text_id", "depth", "prefix", "l", "r"])

    return corpus.select("text_id", "bytes").mapInArrow(found, "text_id bigint, depth int, prefix string, l bigint, r bigint")
