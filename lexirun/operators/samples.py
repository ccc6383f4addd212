"""Subsampled suffix arrays: which run heads keep their sample, and the blocks that answer SA[j] -> SA[j + 1]."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spaced(values: list[int], step: int, required: Collection[int] = (), backward: bool = False) -> list[int]:
    """Of values, rising, those that stay when gaps up to step are enough.

    The first and the last stay. After one that stays, the next to stay is the last one within step, the very next
    value if there is none within, or a required value if that comes earlier. backward: the same from the other end.
    """
    if backward:
        return [-x for x in reversed(spaced([-x for x in reversed(values)], step, {-x for x in required}))]
    needed = [k for k, x in enumerate(values) if x in required]
    kept, k = list(values[:1]), 0
    while k + 1 < len(values):
        reach = max(bisect_right(values, values[k] + step) - 1, k + 1)
        stop = bisect_right(needed, k)
        k = min(reach, needed[stop]) if stop < len(needed) else reach
        kept.append(values[k])
    return kept


def blocks_of(pairs: list[tuple[int, int]], sampled: set[int], size: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, len, diff, valid_area) from pairs (tail of a run, head of the next), sorted by tail.

    A group begins at a pair with a sampled head and runs to the next such pair. Its block is valid from the first
    tail to the second; if that is step or more, this piece is a block of its own, and the rest is cut likewise.
    valid_area 0: the whole block. What lies before the first group has no block.
    """
    firsts = [k for k, (_, head) in enumerate(pairs) if head in sampled]
    for k, begin in enumerate(firsts):
        stop = firsts[k + 1] if k + 1 < len(firsts) else len(pairs)
        end = pairs[stop][0] if stop < len(pairs) else size
        while begin < stop:
            tail, head = pairs[begin]
            area = pairs[begin + 1][0] - tail if begin + 1 < stop else 0
            if area < step:
                yield tail, end - tail, head - tail, area
                break
            yield tail, area, head - tail, 0
            begin += 1


def head_samples(runs: DataFrame, step: int, required: DataFrame | None = None, backward: bool = False) -> DataFrame:
    """text_id, head_sa of the run heads that keep their sample, see spaced. The rule is greedy along the text, so a text is one group.

    required: text_id, head_sa of heads that keep theirs anyway.
    """

    def pick(group: pd.DataFrame, needed: pd.DataFrame | None = None) -> pd.DataFrame:
        kept = spaced(sorted(group["head_sa"]), step, () if needed is None else set(needed["head_sa"]), backward)
        return pd.DataFrame({"text_id": group["text_id"].iloc[0] if len(group) else None, "head_sa": kept}, columns=["text_id", "head_sa"])

    rows = runs.select("text_id", "head_sa").groupBy("text_id")
    if required is None:
        return rows.applyInPandas(lambda group: pick(group), "text_id bigint, head_sa bigint")
    return rows.cogroup(required.select("text_id", "head_sa").groupBy("text_id")).applyInPandas(pick, "text_id bigint, head_sa bigint")


def boundary_pairs(runs: DataFrame, circular: bool = False) -> DataFrame:
    """text_id, tail, head: the tail sample of each run with the head sample of the next; circular: the last with the first too."""
    w = Window.partitionBy("text_id").orderBy("run_id")
    before = F.lag("tail_sa").over(w)
    if circular:
        before = F.coalesce(before, F.last("tail_sa").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return runs.select("text_id", before.alias("tail"), F.col("head_sa").alias("head")).filter("tail is not null")


def phi_blocks(runs: DataFrame, step: int, circular: bool = False, kept: DataFrame | None = None) -> DataFrame:
    """text_id, start, len, diff, valid_area, see blocks_of; kept: what head_samples gives, where it is known."""
    size = runs.groupBy("text_id").agg(F.sum("len").alias("size"))
    pairs = boundary_pairs(runs, circular)
    kept = (head_samples(runs, step) if kept is None else kept).select("text_id", F.col("head_sa").alias("head"), F.lit(True).alias("sampled"))
    rows = pairs.join(kept, ["text_id", "head"], "left").join(size, "text_id").select("text_id", "tail", "head", F.coalesce("sampled", F.lit(False)).alias("sampled"), "size")

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tail")
        found = blocks_of(list(zip(group["tail"], group["head"], strict=True)), set(group["head"][group["sampled"]]), int(group["size"].iloc[0]), step)
        return pd.DataFrame([(group["text_id"].iloc[0], *b) for b in found], columns=["text_id", "start", "len", "diff", "valid_area"])

    return rows.groupBy("text_id").applyInPandas(make, "text_id bigint, start bigint, len bigint, diff bigint, valid_area int")


def overlaps(runs: DataFrame) -> DataFrame:
    """How many gaps between run heads, along the text, hold each number of run tails: tails, gaps. A gap holds its first position."""
    marks = runs.select("text_id", F.col("head_sa").alias("at"), F.lit(0).alias("kind")).unionByName(runs.select("text_id", F.col("tail_sa").alias("at"), F.lit(1).alias("kind")))
    w = Window.partitionBy("text_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    gaps = marks.withColumn("gap", F.sum(1 - F.col("kind")).over(w)).filter("gap > 0").groupBy("text_id", "gap").agg(F.sum("kind").alias("tails"))
    return gaps.groupBy("tails").agg(F.count("*").alias("gaps"))
