"""Texts as bytes. A corpus has a row for each text: text_id bigint, bytes binary, without terminator."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The terminator is below every symbol of a text; the separator stands between the strings of a collection.
TERMINATOR, SEPARATOR = 0, 1


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files make fewer tasks than that, as few or unsplittable files do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def from_strings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One text per row; a null text is left out."""
    return df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("text_id"), F.encode(text_col, "utf-8").alias("bytes"))


def collections(df: DataFrame, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """One text per value of id_col: its strings in the order of order_col, with SEPARATOR between."""
    strings = F.transform(F.sort_array(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col])
    return df.groupBy(F.col(id_col).cast("bigint").alias("text_id")).agg(F.encode(F.array_join(strings, chr(SEPARATOR)), "utf-8").alias("bytes"))


def string_ranges(df: DataFrame, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """Where the strings of collections lie: text_id, string_id (order_col), start, end (exclusive, without separator)."""
    w = Window.partitionBy("text_id").orderBy("string_id").rowsBetween(Window.unboundedPreceding, -1)
    each = df.select(F.col(id_col).cast("bigint").alias("text_id"), F.col(order_col).cast("bigint").alias("string_id"), F.octet_length(text_col).cast("bigint").alias("size")).filter("size is not null")
    start = F.coalesce(F.sum(F.col("size") + 1).over(w), F.lit(0))
    return each.select("text_id", "string_id", start.alias("start"), (start + F.col("size")).alias("end"))


def _holds(symbol: int) -> Column:
    return F.expr(f"position(X'{symbol:02X}', bytes) > 0")


def reserved_symbols(corpus: DataFrame, symbols: tuple[int, ...] = (TERMINATOR,)) -> DataFrame:
    """The texts that hold one of symbols: the terminator, which no text may, or others that are to stand between texts."""
    return corpus.filter(reduce(or_, map(_holds, symbols)))


def checked(corpus: DataFrame) -> DataFrame:
    """corpus, of which a text with the terminator in it raises an error when it is read."""
    return corpus.withColumn("bytes", F.when(_holds(TERMINATOR), F.raise_error(F.concat(F.lit("text holds the terminator: "), F.col("text_id").cast("string"))).cast("binary")).otherwise(F.col("bytes")))


def symbol_at(data: Column, pos: Column) -> Column:
    """The byte of data at pos (from 0) as a number."""
    return F.conv(F.hex(F.substring(data, pos + 1, F.lit(1))), 16, 10).cast("smallint")
