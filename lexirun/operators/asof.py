"""As-of lookups: for each probe the nearest row at or before (or after) it, in one shuffle and one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(probes: DataFrame, rows: DataFrame, by: list[str], at: str, key: str, forward: bool = False, inclusive: bool = True) -> DataFrame:
    """probes with `found`, a struct of the row with the largest key <= at among rows equal in by (null: none).

    forward: the smallest key >= at instead. inclusive false: < and > instead. Both sides go through one window,
    so a probe costs no more than its place in the sort, however many rows lie between.
    """
    build = rows.select(*by, F.col(key).alias("__at"), F.lit(0 if inclusive else 1).alias("__turn"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("__probe"))
    ask = probes.select(*by, F.col(at).alias("__at"), F.lit(1 if inclusive else 0).alias("__turn"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("__row"), F.struct(*probes.columns).alias("__probe"))
    order = F.col("__at").desc() if forward else F.col("__at").asc()
    w = Window.partitionBy(*by).orderBy(order, "__turn").rowsBetween(Window.unboundedPreceding, 0)
    met = build.unionByName(ask).withColumn("found", F.last("__row", ignorenulls=True).over(w)).filter("__probe is not null")
    return met.select("__probe.*", "found")
