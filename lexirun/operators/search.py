"""Count and locate: where patterns (pat_id, pattern: binary) occur in the texts of a corpus.

Occurrences may overlap, none spans two texts; an empty pattern is an error, a null one occurs nowhere, and one that
is absent has count 0 and no rows. Offsets are in bytes, from 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matcher import Matcher
from ..functions.runindex import RunIndex
from ..plans.strategy import asked_of, choose, scan, scan_counts, seed_counts, seeds
from .asof import asof
from .suffix import sorted_texts, suffixes


def locate(corpus: DataFrame, patterns: DataFrame, strategy: str | None = None) -> DataFrame:
    """pat_id, text_id, pos: one row per occurrence. strategy: "scan" or "seeds", see plans.strategy; None: by size."""
    chosen = strategy or choose(patterns)
    return {"scan": scan, "seeds": seeds}[chosen](corpus, patterns)


def count(corpus: DataFrame, patterns: DataFrame, strategy: str | None = None) -> DataFrame:
    """pat_id, n_occ for each row of patterns; rows with one pat_id keep their own counts."""
    chosen = strategy or choose(patterns)
    found = {"scan": scan_counts, "seeds": seed_counts}[chosen](corpus, patterns)
    return patterns.select("pat_id", "pattern").join(found, "pattern", "left").select("pat_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_occ"))


def intervals(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """pat_id, text_id, l, r, n_occ, first_pos (= SA[l]) of each text and pattern that occurs in it.

    A text is sorted, and read once for all patterns; the ranks of a pattern's places are its interval.
    Patterns too many to be sent are located by their seeds and meet the sorted suffixes in a join.
    """
    if choose(patterns) != "scan":
        met = locate(corpus, patterns).join(suffixes(corpus).select("text_id", "i", "pos"), ["text_id", "pos"])
        return met.groupBy("pat_id", "text_id").agg(F.min("i").alias("l"), F.max("i").alias("r"), F.count("*").alias("n_occ"), F.min_by("pos", "i").alias("first_pos"))
    shared = corpus.sparkSession.sparkContext.broadcast(asked_of(patterns))
    names = ["pat_id", "text_id", "l", "r", "n_occ", "first_pos"]

    def found(batches):
        search, ids = Matcher(list(shared.value)), list(shared.value.values())
        for text_id, text, order in sorted_texts(batches):
            hits, where = search.find(text[:-1])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            which, place = np.unique(hits, return_inverse=True)
            low = np.full(len(which), len(order), np.int64)
            np.minimum.at(low, place, rank[where])
            times = np.bincount(place, minlength=len(which))
            rows = [(p, text_id, l, l + n - 1, n, x) for k, l, n, x in zip(which.tolist(), low.tolist(), times.tolist(), order[low].tolist(), strict=True) for p in ids[k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(len(names))], names=names)

    return corpus.select("text_id", "bytes").mapInArrow(found, ", ".join(f"{n} bigint" for n in names))


def _index(runs: pd.DataFrame, blocks: pd.DataFrame | None = None) -> RunIndex:
    runs = runs.sort_values("head_i")
    more = {}
    if blocks is not None and len(blocks):
        blocks = blocks.sort_values("start")
        more = {"starts": blocks["start"].to_numpy(np.int64), "diffs": blocks["diff"].to_numpy(np.int64), "areas": blocks["valid_area"].to_numpy(np.int64)}
    sampled = runs["sampled"].to_numpy(bool) if "sampled" in runs else runs["head_sa"].notna().to_numpy()
    tails = runs["tail_sa"].to_numpy(np.int64) if "tail_sa" in runs else None
    columns = [runs[c].fillna(0).to_numpy(np.int64) for c in ("sym", "head_i", "len", "head_sa")]
    return RunIndex(*columns, sampled, tail_sa=tails, **more)


def _frame(asked: dict[bytes, list[int]], which: np.ndarray, text_id: int, **columns: np.ndarray) -> pd.DataFrame:
    """A row for each id of the patterns at which."""
    ids = list(asked.values())
    times = np.array([len(x) for x in ids], np.int64)[which]
    pat_id = np.array([p for k in which.tolist() for p in ids[k]], np.int64)
    return pd.DataFrame({"pat_id": pat_id, "text_id": np.full(len(pat_id), text_id), **{c: np.repeat(x, times) for c, x in columns.items()}})


def backward_search(runs: DataFrame, patterns: DataFrame, last: bool = False) -> DataFrame:
    """pat_id, text_id, l, r, first_pos (= SA[l]; if last, last_pos = SA[r]) for each text and pattern that occurs in it, by backward search over runs."""
    shared = runs.sparkSession.sparkContext.broadcast(asked_of(patterns))
    name = "last_pos" if last else "first_pos"

    def search(group: pd.DataFrame) -> pd.DataFrame:
        which, l, r, x = _index(group).search(list(shared.value), last)
        return _frame(shared.value, which, group["text_id"].iloc[0], l=l, r=r, **{name: x})

    return runs.groupBy("text_id").applyInPandas(search, f"pat_id bigint, text_id bigint, l bigint, r bigint, {name} bigint")


LOCATED = "pat_id bigint, text_id bigint, ord bigint, pos bigint"


def locate_in_index(runs: DataFrame, blocks: DataFrame | None, patterns: DataFrame, strategy: str = "blocks") -> DataFrame:
    """pat_id, text_id, ord, pos in suffix-array order, from sampled runs (column sampled) and blocks; strategy: see RunIndex.locate.

    Without blocks all samples must be there: head_sa and, for phi and down, tail_sa.
    """
    shared = runs.sparkSession.sparkContext.broadcast(asked_of(patterns))
    whole = blocks is None and strategy in ("phi", "down")

    def search(group: pd.DataFrame, near: pd.DataFrame | None = None) -> pd.DataFrame:
        index = _index(group, near)
        if whole:
            index.complete(strategy == "down")
        which, ord_, pos = index.locate(list(shared.value), strategy)
        return _frame(shared.value, which, group["text_id"].iloc[0], ord=ord_, pos=pos)

    if blocks is None or strategy == "samples":
        return runs.groupBy("text_id").applyInPandas(lambda group: search(group), LOCATED)
    return runs.groupBy("text_id").cogroup(blocks.groupBy("text_id")).applyInPandas(search, LOCATED)


def decode(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, i) with pos = SA[i], walking back to a sampled head."""

    def walk(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"text_id": [], "i": [], "pos": []})
        return pd.DataFrame({"text_id": asked["text_id"], "i": asked["i"], "pos": _index(group).decode(asked["i"].to_numpy(np.int64))})

    return runs.groupBy("text_id").cogroup(probes.select("text_id", "i").toDF("text_id", "i").groupBy("text_id")).applyInPandas(walk, "text_id bigint, i bigint, pos bigint")


def follow(blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (text_id, pos, steps): text_id, pos, ord, next_pos, valid, for ord from 1 to steps: the positions that follow pos in suffix-array order, block by block.

    From the first block that isn't valid on, next_pos is null and valid false; decode() tells more.
    """

    def walk(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values("start")
        none = np.zeros(0, np.int64)
        index = RunIndex(none, none, none, none, none, near["start"].to_numpy(np.int64), near["diff"].to_numpy(np.int64), near["valid_area"].to_numpy(np.int64))
        pos, steps = asked["pos"].to_numpy(np.int64), asked["steps"].to_numpy(np.int64)
        live, x, known, out = np.arange(len(pos)), pos.copy(), np.ones(len(pos), bool), []
        for k in range(1, int(steps.max(initial=0)) + 1):
            live = live[steps[live] >= k]
            y, ok = index.next_positions(x[live])
            known[live] &= ok
            x[live] = np.where(known[live], y, x[live])
            value = pd.Series(x[live], dtype="Int64").mask(~known[live])
            out.append(pd.DataFrame({"text_id": asked["text_id"].to_numpy()[live], "pos": pos[live], "ord": k, "next_pos": value, "valid": known[live]}))
        return pd.concat(out) if out else pd.DataFrame({"text_id": [], "pos": [], "ord": [], "next_pos": [], "valid": []})

    ends = probes.select("text_id", "pos", F.col("steps").cast("bigint").alias("steps"))
    return ends.groupBy("text_id").cogroup(blocks.groupBy("text_id")).applyInPandas(walk, "text_id bigint, pos bigint, ord bigint, next_pos bigint, valid boolean")


def in_strings(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """found (text_id, pos and others) in a collection that is one text, with string_id and offset by ranges (text_id, string_id, start, end)."""
    met = asof(found, ranges.select("text_id", "string_id", "start", "end"), ["text_id"], "pos", "start")
    inside = F.col("pos") < F.col("found.end")
    return met.select(*found.columns, F.when(inside, F.col("found.string_id")).alias("string_id"), F.when(inside, F.col("pos") - F.col("found.start")).alias("offset"))


def locate_ordered(suffixes: DataFrame, intervals: DataFrame) -> DataFrame:
    """pat_id, text_id, ord, pos: the positions of intervals (pat_id, text_id, l, r) in suffix-array order."""
    each = intervals.select("pat_id", "text_id", F.explode(F.sequence("l", "r")).alias("i"), "l")
    return each.join(suffixes.select("text_id", "i", "pos"), ["text_id", "i"]).select("pat_id", "text_id", (F.col("i") - F.col("l")).alias("ord"), "pos")


def query_statistics(counts: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row: n_pats, pat_len (mean), n_occ, missed (patterns without occurrence)."""
    one = F.lit(1).alias("k")
    asked = patterns.agg(F.count("*").alias("n_pats"), F.avg(F.octet_length("pattern")).alias("pat_len")).select("*", one)
    found = counts.agg(F.sum("n_occ").alias("n_occ"), F.sum((F.col("n_occ") == 0).cast("bigint")).alias("missed")).select("*", one)
    return asked.join(found, "k").drop("k")
