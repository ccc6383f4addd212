"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only built-in DataFrame functions are used. A text is read in full only where its length and its prefix
hash are those of another row too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, attach, cut, packed

PREFIX_CHARS = 64


def _signed(text: Column) -> dict[str, Column]:
    """What the first two levels compare: the length in bytes, and a hash of the beginning."""
    whole = F.coalesce(text, F.lit(""))
    return {"__len": F.octet_length(whole).cast("long"), "__prefix": F.xxhash64(ascii_lower(F.substring(whole, 1, PREFIX_CHARS)))}


def _surviving(rows: DataFrame) -> tuple[DataFrame, int]:
    """The groups by length and prefix hash that have two rows or more, with their size __n; and how many rows there are."""
    small = cut(rows.select("__len", "__prefix"))
    total = small.count()
    by_len = cut(small.groupBy("__len").agg(F.count("*").alias("__n")).filter("__n > 1"))
    left = attach(small, by_len, ["__len"], "__n", total).filter("__n is not null")
    return cut(left.groupBy("__len", "__prefix").agg(F.count("*").alias("__n")).filter("__n > 1")), total


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False) -> DataFrame:
    """Which rows of docs stay when equal texts (A-Z lower-cased, null is empty) are collapsed.

    Returns one row per row of docs: doc_id, keep_id (the largest id of the group), group_size, kept, content
    (SHA-256 of the normalised text for rows that reached the last level, else null, or for all rows
    with_digest), and uid, a number of the row. Exactly one row of each group is kept: of rows with the largest
    id twice any one. A null id is smaller than all others. Columns of docs other than these two are ignored,
    whatever their names. Texts of any length are compared whole; an empty table gives an empty one.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    rows = raw.withColumns(_signed(F.col("__text")))
    by_prefix, total = _surviving(rows)

    full = F.sha2(ascii_lower(F.col("__text")), 256)
    met = attach(rows, by_prefix, ["__len", "__prefix"], "__n", total)
    survivor = F.col("__n").isNotNull()
    hashed = cut(
        met.select(
            "doc_id",
            F.when(survivor, full).alias("__full"),
            (full if with_digest else F.when(survivor, full)).alias("content"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    best = F.max(F.struct(F.col("doc_id"), F.col("uid"))).alias("__best")
    groups = cut(hashed.filter("__full is not null").groupBy("__full").agg(best, F.count("*").alias("group_size")).filter("group_size > 1"))
    out = attach(hashed, groups, ["__full"], "group_size", total)
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__best.doc_id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__best.uid") == F.col("uid"))).alias("kept"),
        "content",
        "uid",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that exact_dedup drops.

    The full text is hashed only of rows whose length and prefix another row has too. Of rows with a group's largest
    id twice any one stays; a null id is smaller than all others, a null text is empty. Columns may have any names;
    an empty table gives an empty one.
    """
    rows = packed(docs, id=F.col("doc_id"), text=F.col("text")).withColumns(_signed(F.col("text")))
    by_prefix, total = _surviving(rows)
    met = attach(rows, by_prefix, ["__len", "__prefix"], "__n", total)
    content = F.when(F.col("__n").isNotNull(), F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    met = met.select("row", "id", content.alias("content"))
    same = cut(met.filter("content is not null").groupBy("content", "id").agg(F.count("*").alias("times")))
    groups = cut(same.groupBy("content").agg(F.sum("times").alias("size"), F.max(F.struct("id", "times")).alias("best")).filter("size > 1"))
    judged = attach(met, groups, ["content"], "size", total)
    stays = judged.filter("size is null or (id <=> best.id and best.times = 1)").select("row.*")
    again = groups.filter("best.times > 1")
    if again.isEmpty():
        return stays
    repeated = judged.filter("id <=> best.id and best.times > 1").groupBy("content").agg(F.first("row").alias("row"))
    return stays.unionByName(repeated.select("row.*"))
