"""A total order over a whole table without one sort in one task: sampled splitters and ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges aimed at, sample rows per range, and rounds of subdividing: together they bound what the driver holds.
RANGES, PER_RANGE, ROUNDS = 2048, 24, 4
#: Bits of a minor key that tell rows apart whose keys are otherwise equal.
TIE_BITS = 24


def tied_minor(key: Column, row: Column) -> Column:
    """A minor key: the upper bits of key, a hash, and TIE_BITS of a hash of the number of the row, so that a group of rows equal in key is divisible too."""
    low = (1 << TIE_BITS) - 1
    return key.bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(row).bitwiseAND(F.lit(low)))


def _range_of(splitters: np.ndarray):
    """A function of Arrow batches (major, minor, ...) that appends __range: how many splitters are at most the key."""
    majors = splitters["major"]

    def ranged(batches):
        for b in batches:
            major = b.column("major").to_numpy(zero_copy_only=False)  # bytes or numbers
            minor = b.column("minor").to_numpy(zero_copy_only=False)
            low = np.searchsorted(majors, major, "left")
            high = np.searchsorted(majors, major, "right")
            at = high.copy()
            tied = low < high  # the major is that of some splitters: the minor decides
            for k in np.unique(low[tied]):
                mine = tied & (low == k)
                end = high[mine][0]
                at[mine] = k + np.searchsorted(splitters["minor"][k:end], minor[mine], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "__range"])

    return ranged


def _sample(keys: DataFrame, budget: float, weight: float, seed: int) -> pd.DataFrame:
    """About budget rows, a row drawn with a chance in proportion to its weight, at most 1; __w: what a drawn row stands for."""
    if weight <= 0:
        return pd.DataFrame({"major": [], "minor": [], "__range": [], "__w": []})
    chance = F.least(F.lit(1.0), F.col("weight") * (budget / weight))
    coin = F.pmod(F.xxhash64("major", "minor", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return keys.filter(coin < chance).select("major", "minor", "__range", (F.col("weight") / chance).alias("__w")).toPandas()


def _quantiles(s: pd.DataFrame, parts: int) -> list[tuple]:
    s = s.assign(major=[bytes(x) if isinstance(x, bytearray) else x for x in s["major"]]).sort_values(["major", "minor"])
    c = s["__w"].cumsum().to_numpy()
    if not len(c):
        return []
    at = np.unique(np.searchsorted(c, c[-1] * np.arange(1, parts) / parts))
    return list(zip(s["major"].to_numpy()[at], s["minor"].to_numpy()[at], strict=True))


def _array(pairs: set[tuple], binary: bool) -> np.ndarray:
    return np.array(sorted(pairs), dtype=[("major", "O" if binary else "i8"), ("minor", "i8")])


def ranked(keys: DataFrame, ranges: int = RANGES) -> DataFrame:
    """keys (major long or binary, minor long, weight long, and others), cut before, in order of (major, minor).

    Appends rank (from 0, gapless), before (the weight of all rows ahead), total (of all weights). Splitters come
    from a sample weighted by weight; ranges of over twice their share are sampled and divided again, by minor
    where one major fills them, until there are none, or they hold one key only, or ROUNDS are over. Rows equal in
    both parts of the key keep together; which of them comes first isn't defined. No column may be null.
    """
    spark = keys.sparkSession
    total = keys.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    flat = keys.withColumn("__range", F.lit(0))
    share = max(1, total // ranges)
    pairs = set(_quantiles(_sample(flat, ranges * PER_RANGE, total, 0), ranges))
    for seed in range(1, 2 + ROUNDS):
        dealt = keys.mapInArrow(_range_of(_array(pairs, dict(keys.dtypes)["major"] == "binary")), flat.schema)
        key = F.struct("major", "minor")
        sizes = dealt.groupBy("__range").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), (F.min(key) != F.max(key)).alias("divisible")).toPandas().sort_values("__range")
        over = sizes[(sizes["w"] > 2 * share) & sizes["divisible"].astype(bool)]
        if not len(over) or seed > ROUNDS:
            break
        weights = dict(zip(over["__range"], over["w"], strict=True))
        drawn = _sample(dealt.filter(F.col("__range").isin([int(x) for x in weights])), PER_RANGE * sum(map(float, weights.values())) / share, float(sum(weights.values())), seed)
        more = {p for r, s in drawn.groupby("__range") for p in _quantiles(s, int(weights[r] // share) + 1)}
        if more <= pairs:
            break
        pairs |= more
    start = pd.DataFrame({"__range": sizes["__range"].astype("int32"), "__w0": (sizes["w"].cumsum() - sizes["w"]).astype("int64"), "__n0": (sizes["n"].cumsum() - sizes["n"]).astype("int64")})
    offsets = spark.createDataFrame(start.values.tolist(), "__range int, __w0 long, __n0 long")
    w = Window.partitionBy("__range").orderBy("major", "minor")
    ahead = F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumns({"__ahead": ahead, "__row": F.row_number().over(w) - 1})
    out = placed.join(F.broadcast(offsets), "__range")
    return out.select(*keys.columns, (F.col("__n0") + F.col("__row")).alias("rank"), (F.col("__w0") + F.col("__ahead")).alias("before"), F.lit(int(total)).cast("long").alias("total"))
