"""Sharding by sampled splitters, balanced to the byte."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .ranking import ranked, tied_minor

ROW_BYTES = 16


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals docs into shards of nearly equal bytes, equal texts next to each other.

    Records are ordered by (hash of the text, hash of the id); size-weighted samples of these keys give quantile
    splitters, the table is range-partitioned by them, and overfull ranges, such as a group of copies, are
    subdivided. The exact weight of each range then places every record: its shard is that of the first of its
    bytes, so shards differ from total / shards by less than one record. Returns one row per row of docs: doc_id,
    size (UTF-8 bytes plus ROW_BYTES; null text: ROW_BYTES), text_crc32, shard, slot (gapless from 0 in each shard
    that has rows). A null id takes part like any other. Rows equal in id and text get slots in any order, and a group
    of them is subdivided like any other. Texts of any length stay whole; with records larger than a shard's share,
    some shards may stay empty. An empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    text = F.coalesce(F.col("__text"), F.lit(""))
    keys = cut(
        raw.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("weight"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.xxhash64(text).alias("major"),
            tied_minor(F.xxhash64("doc_id"), F.monotonically_increasing_id()).alias("minor"),
        )
    )
    shard = F.least(F.lit(shards - 1), F.floor(F.col("before") * F.lit(shards).cast("decimal(10,0)") / F.col("total"))).cast("int")
    placed = cut(ranked(keys).select("doc_id", F.col("weight").alias("size"), "text_crc32", shard.alias("shard"), "rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("__first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("__first")).alias("slot"))
