"""Point queries over runs and suffixes: probes are rows, answers are columns added to them.

Positions count from 0; rank(i, c) is how often c occurs before position i and is total: a symbol that the text
lacks has rank 0 everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import asof


def access(found: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i) with sym = BWT[i], null beyond the end."""
    met = asof(probes, found.select("text_id", "head_i", "len", "sym"), ["text_id"], "i", "head_i")
    inside = F.col("i") < F.col("found.head_i") + F.col("found.len")
    return met.select(*probes.columns, F.when(inside, F.col("found.sym")).alias("sym"))


def rank(found: DataFrame, probes: DataFrame, at: str = "i", name: str = "rank", head: str = "is_head") -> DataFrame:
    """probes (text_id, at, sym) with name, the rank, and head: no run of sym reaches from before at to at."""
    met = asof(probes, found.select("text_id", "sym", "head_i", "len", "rank_before"), ["text_id", "sym"], at, "head_i", inclusive=False)
    f = F.col("found")
    value = F.coalesce(f["rank_before"] + F.least(F.col(at) - f["head_i"], f["len"]), F.lit(0))
    inside = F.coalesce(F.col(at) < f["head_i"] + f["len"], F.lit(False))
    return met.select(*probes.columns, value.alias(name), (~inside).alias(head))


def range_rank(found: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i, j, sym and any others, rows may repeat) with rank_i, rank_j and i_is_head."""
    both = rank(found, rank(found, probes, "i", "rank_i", "i_is_head"), "j", "rank_j", "__head")
    return both.select(*probes.columns, "rank_i", "rank_j", "i_is_head")


def select(found: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, sym, k) with i, the position of the k-th (from 0) sym; null if there are fewer."""
    met = asof(probes, found.select("text_id", "sym", "head_i", "len", "rank_before"), ["text_id", "sym"], "k", "rank_before")
    f = F.col("found")
    return met.select(*probes.columns, F.when(F.col("k") < f["rank_before"] + f["len"], f["head_i"] + F.col("k") - f["rank_before"]).alias("i"))


def inverse_select(found: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i) with sym = BWT[i], rank(i, sym), and head_sa, SA[i] where i is a run's head."""
    met = asof(probes, found.select("text_id", "head_i", "sym", "rank_before", "head_sa"), ["text_id"], "i", "head_i")
    f = F.col("found")
    return met.select(*probes.columns, f["sym"].alias("sym"), (f["rank_before"] + F.col("i") - f["head_i"]).alias("rank"), F.when(F.col("i") == f["head_i"], f["head_sa"]).alias("head_sa"))


def lf(found: DataFrame, c_table: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i) with lf, where the symbol BWT[i] stands in the first column."""
    return inverse_select(found, probes).join(c_table.select("text_id", "sym", "c_lo"), ["text_id", "sym"]).select(*probes.columns, (F.col("c_lo") + F.col("rank")).alias("lf"))


def first_symbol(c_table: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i) with sym, the first symbol of the i-th suffix, and k, its number among those."""
    met = asof(probes, c_table.select("text_id", "sym", "c_lo"), ["text_id"], "i", "c_lo")
    return met.select(*probes.columns, F.col("found.sym").alias("sym"), (F.col("i") - F.col("found.c_lo")).alias("k"))


def fl(found: DataFrame, c_table: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i) with fl, the inverse of lf."""
    named = first_symbol(c_table, probes)
    return select(found, named).toDF(*named.columns, "fl").select(*probes.columns, "fl")


def successor_head(found: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i, sym) with succ_i and succ_sa of the first run head of sym at or after i; null if none."""
    met = asof(probes, found.select("text_id", "sym", "head_i", "head_sa"), ["text_id", "sym"], "i", "head_i", forward=True)
    return met.select(*probes.columns, F.col("found.head_i").alias("succ_i"), F.col("found.head_sa").alias("succ_sa"))


def lf_range(found: DataFrame, c_table: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i, j, sym and any others) with l, r: the interval of what begins with sym and goes on as in [i, j]; null if empty."""
    ends = range_rank(found, probes.withColumn("__j", F.col("j")).withColumn("j", F.col("j") + 1))
    named = ends.join(c_table.select("text_id", "sym", "c_lo"), ["text_id", "sym"], "left").withColumn("j", F.col("__j"))
    some = F.col("rank_j") > F.col("rank_i")
    return named.select(*probes.columns, F.when(some, F.col("c_lo") + F.col("rank_i")).alias("l"), F.when(some, F.col("c_lo") + F.col("rank_j") - 1).alias("r"))


def run_of_position(found: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i) with run_id, offset in that run, is_head, is_tail; null beyond the end."""
    met = asof(probes, found.select("text_id", "head_i", "len", "run_id"), ["text_id"], "i", "head_i")
    f, offset = F.col("found"), F.col("i") - F.col("found.head_i")
    here = lambda x: F.when(offset < f["len"], x)
    return met.select(*probes.columns, here(f["run_id"]).alias("run_id"), here(offset).alias("offset"), here(offset == 0).alias("is_head"), here(offset == f["len"] - 1).alias("is_tail"))


def run_range(found: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, run_id) with sym, l, r: the run's symbol and its first and last position; null if there is no such run."""
    ends = found.select("text_id", "run_id", "sym", F.col("head_i").alias("l"), (F.col("head_i") + F.col("len") - 1).alias("r"))
    return probes.join(ends, ["text_id", "run_id"], "left").select(*probes.columns, "sym", "l", "r")


def break_range(found: DataFrame, probes: DataFrame, size: int = 1024) -> DataFrame:
    """probes (text_id, i, j, sym), each with the largest intervals l, r within [i, j] that hold sym only; none: no row.

    Runs and probes meet by the blocks of size positions that they touch; a pair meets once, in the block where its
    later beginning lies.
    """
    touched = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size))).alias("__block")
    ends = found.select("text_id", "sym", F.col("head_i").alias("__l"), (F.col("head_i") + F.col("len") - 1).alias("__r"))
    met = probes.filter("i <= j").select("*", touched(F.col("i"), F.col("j"))).join(ends.select("*", touched(F.col("__l"), F.col("__r"))), ["text_id", "sym", "__block"])
    l, r = F.greatest("i", "__l"), F.least("j", "__r")
    return met.filter((l <= r) & (F.floor(l / size) == F.col("__block"))).select(*probes.columns, l.alias("l"), r.alias("r"))


def closest_break(found: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i, j, sym) with closest: the position of sym in [i, j] closest to i that has another symbol beside it within; null if there is none.

    That is the end of the run that i lies in, if sym's, and otherwise the first sym after i.
    """
    rows = found.select("text_id", "sym", "head_i", "len")
    f = F.col("found")
    inside = asof(probes, rows, ["text_id", "sym"], "i", "head_i").select(*probes.columns, F.when(F.col("i") < f["head_i"] + f["len"], f["head_i"] + f["len"] - 1).alias("__end"))
    met = asof(inside, rows, ["text_id", "sym"], "i", "head_i", forward=True)
    at = F.when(F.col("__end").isNotNull(), F.when(F.col("__end") < F.col("j"), F.col("__end"))).otherwise(F.when(f["head_i"] <= F.col("j"), f["head_i"]))
    return met.select(*probes.columns, at.alias("closest"))


def successor_soft(found: DataFrame, probes: DataFrame, key: str, at: str) -> DataFrame:
    """probes (text_id, at) with succ, the smallest key >= at of their text; beyond the last, null."""
    met = asof(probes, found.select("text_id", key), ["text_id"], at, key, forward=True)
    return met.select(*probes.columns, F.col(f"found.{key}").alias("succ"))


def gaps(found: DataFrame, key: str) -> DataFrame:
    """text_id, key, gap: how far each key is from the one before it in its text (the first: from -1)."""
    before = F.lag(key, 1, -1).over(Window.partitionBy("text_id").orderBy(key))
    return found.select("text_id", key, (F.col(key) - before).alias("gap"))


def predecessor_circular(found: DataFrame, probes: DataFrame, key: str, at: str) -> DataFrame:
    """probes (text_id, at) with pred, the largest key <= at of their text; before the first, the last of all."""
    rows = found.select("text_id", key)
    met = asof(probes, rows, ["text_id"], at, key)
    top = rows.groupBy("text_id").agg(F.max(key).alias("__last"))
    return met.join(top, "text_id").select(*probes.columns, F.coalesce(F.col(f"found.{key}"), F.col("__last")).alias("pred"))


def phi_inverse(suffixes: DataFrame) -> DataFrame:
    """text_id, pos, next_pos: for SA[j] the value SA[j + 1]; null for the last."""
    return suffixes.select("text_id", "pos", F.lead("pos").over(Window.partitionBy("text_id").orderBy("i")).alias("next_pos"))


def phi(suffixes: DataFrame) -> DataFrame:
    """text_id, pos, prev_pos: for SA[j] the value SA[j - 1]; null for the first."""
    return suffixes.select("text_id", "pos", F.lag("pos").over(Window.partitionBy("text_id").orderBy("i")).alias("prev_pos"))


def phi_from_blocks(blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, pos) with next_pos as the sampled blocks tell it, null where no block is valid."""
    met = asof(probes, blocks.select("text_id", "start", "diff", "valid_area"), ["text_id"], "pos", "start")
    f = F.col("found")
    valid = (f["valid_area"] == 0) | (F.col("pos") - f["start"] < f["valid_area"])
    return met.select(*probes.columns, F.when(valid, F.col("pos") + f["diff"]).alias("next_pos"))
