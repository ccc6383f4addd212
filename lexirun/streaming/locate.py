"""Standing patterns over a stream of texts: the same scan, batch by batch, with nothing kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.strategy import scan


def locate_stream(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """pat_id, text_id, pos for a streaming corpus (text_id, bytes) and static patterns."""
    return scan(corpus, patterns)


def count_stream(corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """Running counts by pattern; write it in update or complete mode."""
    return scan(corpus, patterns).groupBy("pat_id").agg(F.count("*").alias("n_occ"))
