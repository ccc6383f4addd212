"""An index over a corpus as tables: built at one of three levels, saved, loaded and checked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators import samples as S
from ..operators import search
from ..operators.suffix import sampled_runs, sorted_runs
from ..sources import formats
from .store import written

#: What is kept at each level, runs only, with some head samples, with all that locating takes, or with the samples of all heads and tails.
LEVELS = ("rlbwt", "toehold", "csa", "rindex")
#: What locating may go by, and the levels that have it, see RunIndex.locate.
STRATEGIES = {"blocks": ("csa",), "samples": ("toehold", "csa", "rindex"), "phi": ("rindex",), "down": ("rindex",)}
FORMAT = 1


@dataclass
class TextIndex:
    level: str
    step: int
    runs: DataFrame
    c_table: DataFrame
    blocks: DataFrame | None = None
    path: str | None = None

    def count(self, patterns: DataFrame) -> DataFrame:
        """pat_id, text_id, l, r of each text and pattern that occurs in it, at any level."""
        return search.backward_search(self._searchable(), patterns).select("pat_id", "text_id", "l", "r")

    def count_with_head(self, patterns: DataFrame) -> DataFrame:
        """The same with first_pos = SA[l]."""
        self._need("toehold", "csa", "rindex")
        return search.backward_search(self._searchable(), patterns)

    def count_with_tail(self, patterns: DataFrame) -> DataFrame:
        """The same with last_pos = SA[r]."""
        self._need("rindex")
        return search.backward_search(self.runs, patterns, last=True)

    def locate(self, patterns: DataFrame, strategy: str | None = None) -> DataFrame:
        """pat_id, text_id, ord, pos in suffix-array order; strategy: one of STRATEGIES that the level has, by default the first."""
        known = [s for s, levels in STRATEGIES.items() if self.level in levels]
        if strategy is None and self.level != "toehold":
            strategy = "blocks" if self.level == "csa" else "phi"
        if strategy not in known:
            self._need(*STRATEGIES.get(strategy, ("csa", "rindex")))
            raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(known)}")
        return search.locate_in_index(self._searchable(), self.blocks, patterns, strategy)

    def metadata(self) -> DataFrame:
        """One row: format, level, step, texts, n, r, sigma."""
        total = self.runs.agg(F.countDistinct("text_id").alias("texts"), F.coalesce(F.sum("len"), F.lit(0)).alias("n"), F.count("*").alias("r"), F.countDistinct("sym").alias("sigma"))
        return total.select(F.lit(FORMAT).alias("format"), F.lit(self.level).alias("level"), F.lit(self.step).alias("step"), "*")

    def space(self) -> DataFrame:
        """What a saved index takes: table, rows, bytes, and bits_per_symbol of the texts."""
        if self.path is None:
            raise ValueError("only a saved index takes space")
        spark, n = self.runs.sparkSession, max(1, self.metadata().first().n)
        rows = []
        for name, df in self._tables().items():
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
            rows.append((name, df.count(), size, 8 * size / n))
        return spark.createDataFrame(rows, "table string, rows bigint, bytes bigint, bits_per_symbol double")

    def _tables(self) -> dict[str, DataFrame]:
        found = {"runs": self.runs.repartition("text_id").sortWithinPartitions("text_id", "head_i"), "c_table": self.c_table, "blocks": self.blocks}
        return {name: df for name, df in found.items() if df is not None}

    def _need(self, *levels: str) -> None:
        if self.level not in levels:
            raise ValueError(f"the index is of level {self.level}; this takes {' or '.join(levels)}")

    def _searchable(self) -> DataFrame:
        """Without samples a search still needs text positions for nothing but SA[l]; heads count as sampled at 0."""
        return self.runs if self.level != "rlbwt" else self.runs.withColumns({"head_sa": F.lit(0).cast("bigint"), "sampled": F.lit(True)})

    def save(self, path: str) -> TextIndex:
        """This index as the tables at path, which are read from there from now on."""
        for name, df in self._tables().items():
            df.write.parquet(f"{path}/{name}")
        self.metadata().coalesce(1).write.parquet(f"{path}/metadata")  # last: an index without it isn't complete
        return load_index(self.runs.sparkSession, path)


def build_index(corpus: DataFrame, level: str = "csa", step: int = 8, sorter: str = "doubling") -> TextIndex:
    """step: how far apart, in the text, head samples may be at most; a larger one keeps fewer. sorter: one of suffixsort.SORTERS.

    The texts are sorted once: their runs are written, and all else is made of these.
    """
    _check(level, step)
    return index_of_runs(written(sorted_runs(corpus, sorter)), level, step)


def _check(level: str, step: int) -> None:
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; known: {', '.join(LEVELS)}")
    if not 0 < step < 1 << 15:
        raise ValueError("step must be from 1 to 32767")


def index_of_runs(found: DataFrame, level: str = "csa", step: int = 8) -> TextIndex:
    """An index of runs with all their samples (see operators.runs), which are read several times and so should be a written table."""
    _check(level, step)
    table = R.c_table(found)
    columns = ["text_id", "run_id", "sym", "head_i", "len", "rank_before"]
    if level == "rlbwt":
        return TextIndex(level, step, found.select(columns), table)
    if level == "rindex":
        return TextIndex(level, step, found.select(*columns, "head_sa", "tail_sa", F.lit(True).alias("sampled")), table)
    heads = written(S.head_samples(found, step).withColumn("sampled", F.lit(True)))
    kept = found.join(heads, ["text_id", "head_sa"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(False)))
    kept = written(kept.withColumn("head_sa", F.when(F.col("sampled"), F.col("head_sa"))).select(*columns, "head_sa", "sampled"))
    return TextIndex(level, step, kept, table, written(S.phi_blocks(found, step, kept=heads)) if level == "csa" else None)


def index_from_files(spark: SparkSession, transform: str, form: str = "plain", heads: str | None = None, tails: str | None = None, level: str = "csa", step: int = 8, text_id: int = 0) -> TextIndex:
    """An index of one text whose transform is in a file (see sources.formats), and the samples of its run heads and tails in two others.

    Without these, or where one is missing, the samples are worked out from the transform alone.
    """
    _check(level, step)
    found = formats.read_bwt(spark, transform, form).select(F.lit(text_id).cast("bigint").alias("text_id"), "run_id", F.col("sym").cast("smallint").alias("sym"), "head_i", "len")
    if heads is None or tails is None:
        return index_of_runs(written(sampled_runs(found)), level, step)
    for name, path in (("head_sa", heads), ("tail_sa", tails)):
        found = found.join(formats.read_samples(spark, path).withColumnRenamed("sample", name), "run_id", "left")
    whole = written(R.with_ranks(found).select("text_id", "run_id", "sym", "head_i", "len", "head_sa", "tail_sa", "rank_before"))
    if not whole.filter("head_sa is null or tail_sa is null").isEmpty():
        raise ValueError("fewer samples than runs")
    return index_of_runs(whole, level, step)


def read_metadata(spark: SparkSession, path: str):
    rows = spark.read.parquet(f"{path}/metadata").collect()
    if len(rows) != 1 or rows[0].format != FORMAT or rows[0].level not in LEVELS:
        raise ValueError(f"not an index that this version reads: {path}")
    return rows[0]


def load_index(spark: SparkSession, path: str) -> TextIndex:
    meta = read_metadata(spark, path)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    index = TextIndex(meta.level, meta.step, read("runs"), read("c_table"), read("blocks") if meta.level == "csa" else None, path)
    found = index.metadata().first()
    if (found.n, found.r) != (meta.n, meta.r):
        raise ValueError(f"the index is damaged: {found.n} positions in {found.r} runs, not {meta.n} in {meta.r}")
    return index
