"""Summaries of measurements: outlier-free histograms and best-and-worst tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.store import written


def _at_ranks(values: DataFrame, ranks: list[int]) -> list[float]:
    """The values at ranks (from 0) of values (x, n: how often it comes, part), written before; a part has a range of x of its own.

    Ranks are counted within the parts, after what all parts before hold, so no task sees more than a part.
    """
    parts = values.groupBy("part").agg(F.min("x").alias("least"), F.sum("n").alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    upto = F.col("ahead") + F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    placed = values.join(F.broadcast(parts.select("part", ahead.alias("ahead"))), "part").select("x", upto.alias("upto"))
    return list(placed.agg(*[F.min(F.when(F.col("upto") > k, F.col("x"))).alias(f"r{i}") for i, k in enumerate(ranks)]).first())


def histogram(df: DataFrame, column: str, bins: int = 20, reach: float = 1.5) -> DataFrame:
    """bin (from 0), n: equal bins from the minimum to the largest value that is no outlier.

    A value is an outlier above Q3 + reach * (Q3 - Q1), the quartiles interpolated over all values. With one value
    only, all falls in bin 0; nulls aren't counted, and an empty table has no bins. Values are counted where they
    are alike, then dealt by range; only quartiles and ends reach the driver.
    """
    counted = df.select(F.col(column).cast("double").alias("x")).filter("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    values = written(counted.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return values.select(F.lit(0).cast("bigint").alias("bin"), "n")
    places = [share * (total - 1) for share in (0.25, 0.75)]
    found = _at_ranks(values, [int(p) + k for p in places for k in (0, 1 if p > int(p) else 0)])
    q1, q3 = (low + (p - int(p)) * (high - low) for p, low, high in zip(places, found[::2], found[1::2], strict=True))
    kept = values.filter(F.col("x") <= q3 + reach * (q3 - q1))
    lo, hi = kept.agg(F.min("x"), F.max("x")).first()
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
    return kept.select(place.cast("bigint").alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))


def extremes(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Least and greatest value of each group, and how many times the one the other is."""
    return df.groupBy(*by).agg(F.min(column).alias("least"), F.max(column).alias("most"), (F.max(column) / F.min(column)).alias("ratio"))
