"""Pattern sets drawn from a corpus, and filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import count

#: How many blocks of places there are for each place that is drawn, so that refused ones matter little.
SPARE = 64


def _drawn(sizes: DataFrame, block: Column | int, seed: int) -> DataFrame:
    """sizes (text_id, n and others) with a place (pos) for each block of places below n, drawn within the block, and a random key."""
    block = F.lit(block) if isinstance(block, int) else block
    each = sizes.withColumn("__block", block.cast("bigint")).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("__block")))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "text_id", "__k"))
    offset = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), F.col("__block"))
    return each.withColumn("key", key).withColumn("pos", F.col("__k") * F.col("__block") + offset).filter("pos < n").drop("__block", "__k")


def sample_patterns(corpus: DataFrame, number: int, length: int, forbidden: int | None = None, seed: int = 0) -> DataFrame:
    """number windows of length bytes at distinct random places, none with the byte forbidden in it.

    The places of each text fall into blocks, SPARE times number in all, or of one place if they are fewer. A block
    offers one place, and the lowest of random keys win, so each place has the same chance; if too many were
    refused, blocks are halved. Keys and places come from seed, text and block, so the draw is the same wherever it
    runs. Returns pat_id (from 0, by key), text_id, pos, pattern.
    """
    texts = corpus.filter(F.octet_length("bytes") >= length).select("text_id", "bytes", (F.octet_length("bytes") - length + 1).cast("bigint").alias("n"))
    block = max(1, (texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 0) // (number * SPARE))
    while True:
        drawn = _drawn(texts, block, seed).withColumn("pattern", F.expr(f"substring(bytes, cast(pos AS int) + 1, {length})"))
        if forbidden is not None:
            drawn = drawn.filter(F.expr(f"position(X'{forbidden:02X}', pattern) = 0"))
        chosen = drawn.select("text_id", "pos", "pattern", "key").orderBy("key", "text_id", "pos").limit(number).collect()  # `number` rows
        if len(chosen) == number or block == 1:
            break
        block //= 2
    rows = [(k, r.text_id, r.pos, r.pattern) for k, r in enumerate(chosen)]
    return corpus.sparkSession.createDataFrame(rows, "pat_id bigint, text_id bigint, pos bigint, pattern binary")


def sample_positions(sizes: DataFrame, number: int, seed: int = 0) -> DataFrame:
    """text_id, i: for each text of sizes (text_id, n) number distinct positions below n (all, if there are fewer), drawn as sample_patterns draws."""
    block = F.greatest(F.lit(1), F.floor(F.col("n") / (4 * number)))
    w = Window.partitionBy("text_id").orderBy("key", "pos")
    each = _drawn(sizes.filter("n > 0").select("text_id", "n"), block, seed)
    return each.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= number).select("text_id", F.col("pos").alias("i"))


def at_most(corpus: DataFrame, patterns: DataFrame, most: int) -> DataFrame:
    """The patterns with at most `most` occurrences, with n_occ."""
    return patterns.join(count(corpus, patterns).filter(F.col("n_occ") <= most), "pat_id")


def windows(patterns: DataFrame, length: int) -> DataFrame:
    """pat_id, pattern: the distinct windows of length bytes of all patterns; pat_id is a number of ours, the same wherever it runs."""
    places = F.explode(F.sequence(F.lit(0), F.octet_length("pattern") - length)).alias("pos")
    each = patterns.filter(F.octet_length("pattern") >= length).select("pattern", places).select(F.expr(f"substring(pattern, pos + 1, {length})").alias("pattern")).distinct()
    return each.select(F.xxhash64("pattern").alias("pat_id"), "pattern")


def fasta(patterns: DataFrame) -> DataFrame:
    """value: two lines, name and sequence, for each pattern; write it with format text."""
    return patterns.select(F.concat(F.lit(">pat_"), F.col("pat_id").cast("string"), F.lit("\n"), F.decode("pattern", "utf-8")).alias("value"))
