"""Connected components of a graph whose links are rows; nothing of it is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fits, lookup, spread_join, spread_of


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node in links (a, b: long): comp is the smallest node that can be reached.

    Each turn a node takes the smallest label of its neighbours and then that label's own label, so a star
    takes two turns and a chain about as many as its length has binary digits. Neither the links of a hub nor the
    nodes of a large component gather in one task: where labels are too many to be broadcast, hot keys are spread.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    small, hubs = fits(label), None
    if not small:
        hubs = spread_of(both.groupBy("b").agg(F.count("*").alias("__n")), "__n", max(1, both.count()))
    while True:
        named = label.select(F.col("node").alias("b"), F.col("comp").alias("m"))
        met = both.join(F.broadcast(named), "b") if small else spread_join(both, named, ["b"], hubs)
        near = met.groupBy("a").agg(F.min("m").alias("m"))
        told = label.join(near, label["node"] == near["a"], "left").select("node", "comp", F.least("comp", F.coalesce("m", "comp")).alias("new"))
        told = told if small else cut(told)
        jump = told.select(F.col("node").alias("new"), F.col("new").alias("far"))
        met = told.join(F.broadcast(jump), "new", "left") if small else lookup(told, jump, ["new"])
        after = cut(met.select("node", F.col("comp").alias("old"), F.least("new", F.coalesce("far", "new")).alias("comp")))
        if not small:
            discard(told)
        label = after.select("node", "comp")
        label.cut_path = after.cut_path
        if after.filter("old <> comp").isEmpty():
            return label
