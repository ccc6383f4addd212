"""All queries by name, each over whole tables; oracles.py has the same in SQL.

Two corpora: the documents, searched for benchmark passages; and the part names of each part size, in the order of
their keys, as collections of strings, which are small, repetitive and indexed in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import statistics
from .operators import corpus as C
from .operators import patterns as P
from .operators import primitives as Q
from .operators import runs as R
from .operators import samples as S
from .operators import search as U
from .operators import suffix as X
from .oracles import ORACLES
from .plans.index import build_index

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STEP, FIXED, DRAWN, NEWLINE, MOST = 8, 16, 200, 10, 1


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_strings(C.spread(_table(spark, sf_dir, "documents")), "doc_id", "text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pat_id"), F.encode("text", "utf-8").alias("pattern"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collections(_table(spark, sf_dir, "part"), "p_size", "p_partkey", "p_name")


def name_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct part name, and each read backwards, which mostly doesn't occur."""
    part = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").cast("bigint").alias("k"))
    both = part.select((2 * F.col("k")).alias("pat_id"), "p_name").unionByName(part.select((2 * F.col("k") + 1).alias("pat_id"), F.reverse("p_name").alias("p_name")))
    return both.select("pat_id", F.encode("p_name", "utf-8").alias("pattern"))


def name_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.suffixes(names(spark, sf_dir))


def name_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sorted_runs(names(spark, sf_dir))


def name_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.string_ranges(_table(spark, sf_dir, "part"), "p_size", "p_partkey", "p_name")


def _sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("text_id").agg(F.sum("len").alias("n"))


def _places(found: DataFrame, name: str = "i", beyond: int = 0) -> DataFrame:
    """text_id, name: all positions of each text, and so many beyond its end."""
    return _sizes(found).select("text_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1 + beyond)).alias(name))


def _symbol_places(found: DataFrame) -> DataFrame:
    """text_id, i, sym: each position with its symbol and with the symbol before it, and both ends with all symbols."""
    every = R.expand(found)
    symbols = found.select("text_id", "sym").distinct()
    ends = _sizes(found).select("text_id", F.explode(F.array(F.lit(0).cast("bigint"), "n")).alias("i")).join(symbols, "text_id")
    return every.unionByName(every.withColumn("i", F.col("i") + 1)).unionByName(ends).distinct()


def _symbol_ranges(found: DataFrame) -> DataFrame:
    """text_id, i, j, sym: from each run's head into the run after the next, with its symbol, and the middle of each text with all symbols."""
    sizes, symbols = _sizes(found), found.select("text_id", "sym").distinct()
    middle = sizes.join(symbols, "text_id").select("text_id", F.expr("n div 4").alias("i"), F.expr("3 * n div 4").alias("j"), "sym")
    reach = F.least(F.col("head_i") + 2 * F.col("len") + 1, F.col("n") - 1)
    return found.join(sizes, "text_id").select("text_id", F.col("head_i").alias("i"), reach.alias("j"), "sym").unionByName(middle).distinct()


@query
def locate_benchmark_in_documents(spark, sf_dir):
    return U.locate(documents(spark, sf_dir), passages(spark, sf_dir))


@query
def locate_benchmark_by_seeds(spark, sf_dir):
    return U.locate(documents(spark, sf_dir), passages(spark, sf_dir), "seeds")


@query
def count_benchmark_in_documents(spark, sf_dir):
    return U.count(documents(spark, sf_dir), passages(spark, sf_dir))


@query
def count_statistics(spark, sf_dir):
    asked = passages(spark, sf_dir)
    return U.query_statistics(U.count(documents(spark, sf_dir), asked), asked)


@query
def qgram_count_fixed_len(spark, sf_dir):
    asked = P.windows(passages(spark, sf_dir), FIXED)
    return U.count(documents(spark, sf_dir), asked).join(asked, "pat_id").select(F.hex("pattern").alias("pattern"), "n_occ")


@query
def pattern_sample_forbidden(spark, sf_dir):
    drawn = P.sample_patterns(documents(spark, sf_dir), DRAWN, 2 * FIXED, NEWLINE)
    return drawn.select("pat_id", "text_id", "pos", F.hex("pattern").alias("pattern"))


@query
def pattern_filter_max_freq(spark, sf_dir):
    return P.at_most(documents(spark, sf_dir), passages(spark, sf_dir), MOST).select("pat_id", F.hex("pattern").alias("pattern"), "n_occ")


@query
def pattern_fasta(spark, sf_dir):
    return P.fasta(passages(spark, sf_dir))


@query
def symbol_histogram(spark, sf_dir):
    return R.symbol_histogram(documents(spark, sf_dir))


@query
def c_array(spark, sf_dir):
    return R.alphabet(R.symbol_histogram(documents(spark, sf_dir))).select("sym", "c_lo")


@query
def effective_alphabet(spark, sf_dir):
    return R.alphabet(R.symbol_histogram(documents(spark, sf_dir))).select("sym", "code", "freq")


@query
def suffix_array_part_names(spark, sf_dir):
    return name_suffixes(spark, sf_dir).select("text_id", "i", "pos")


@query
def suffix_array_by_window(spark, sf_dir):
    return X.suffixes_by_window(C.from_strings(_table(spark, sf_dir, "part"), "p_partkey", "p_name"))


@query
def bwt_part_names(spark, sf_dir):
    return name_suffixes(spark, sf_dir).select("text_id", "i", "sym")


@query
def rle_runs_part_names(spark, sf_dir):
    return R.runs(name_suffixes(spark, sf_dir)).select("text_id", "run_id", "sym", "head_i", "len", "rank_before")


@query
def rle_roundtrip(spark, sf_dir):
    return R.expand(name_runs(spark, sf_dir))


@query
def separator_run_split(spark, sf_dir):
    return R.split_separators(name_runs(spark, sf_dir), C.SEPARATOR)


@query
def run_heads_tails(spark, sf_dir):
    return name_runs(spark, sf_dir).select("text_id", "run_id", "head_sa", "tail_sa")


@query
def c_table_part_names(spark, sf_dir):
    return R.c_table(name_runs(spark, sf_dir))


@query
def access_points(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.access(found, _places(found, beyond=1))


@query
def rank_points(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.rank(found, _symbol_places(found))


@query
def range_rank_points(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.range_rank(found, _symbol_ranges(found))


@query
def select_points(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("freq"))).alias("k")
    return Q.select(found, R.c_table(found).select("text_id", "sym", k))


@query
def inverse_select_points(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.inverse_select(found, R.expand(found).select("text_id", "i"))


@query
def lf_mapping(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.lf(found, R.c_table(found), R.expand(found).select("text_id", "i"))


@query
def fl_mapping(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.fl(found, R.c_table(found), R.expand(found).select("text_id", "i"))


@query
def psi_function(spark, sf_dir):
    return X.psi(name_suffixes(spark, sf_dir))


@query
def successor_run_head(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.successor_head(found, _symbol_places(found))


@query
def circular_predecessor(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.predecessor_circular(found, _places(found, "pos"), "head_sa", "pos")


@query
def soft_successor(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.successor_soft(found, _places(found, "pos"), "tail_sa", "pos")


@query
def head_gaps(spark, sf_dir):
    return Q.gaps(name_runs(spark, sf_dir), "head_sa")


@query
def lf_range(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.lf_range(found, R.c_table(found), _symbol_ranges(found))


@query
def random_positions(spark, sf_dir):
    return P.sample_positions(_sizes(name_runs(spark, sf_dir)), 10)


@query
def reserved_symbols(spark, sf_dir):
    return C.reserved_symbols(documents(spark, sf_dir), (C.TERMINATOR, NEWLINE)).select("text_id")


@query
def phi_inverse(spark, sf_dir):
    return Q.phi_inverse(name_suffixes(spark, sf_dir))


@query
def phi_backward(spark, sf_dir):
    return Q.phi(name_suffixes(spark, sf_dir))


@query
def sa_interval_count(spark, sf_dir):
    return U.intervals(names(spark, sf_dir), name_patterns(spark, sf_dir)).select("pat_id", "text_id", "l", "r", "n_occ")


@query
def toehold(spark, sf_dir):
    return U.intervals(names(spark, sf_dir), name_patterns(spark, sf_dir)).select("pat_id", "text_id", "l", "first_pos")


@query
def locate_sa_order(spark, sf_dir):
    corpus = names(spark, sf_dir)
    return U.locate_ordered(X.suffixes(corpus), U.intervals(corpus, name_patterns(spark, sf_dir)))


@query
def backward_search(spark, sf_dir):
    return build_index(names(spark, sf_dir), "toehold", STEP).count_with_head(name_patterns(spark, sf_dir))


@query
def backward_search_runs_only(spark, sf_dir):
    return build_index(names(spark, sf_dir), "rlbwt").count(name_patterns(spark, sf_dir))


@query
def locate_via_phi(spark, sf_dir):
    return build_index(names(spark, sf_dir), "csa", STEP).locate(name_patterns(spark, sf_dir))


@query
def decode_suffix_array(spark, sf_dir):
    index = build_index(names(spark, sf_dir), "toehold", STEP)
    return U.decode(index.runs, _places(index.runs))


@query
def index_metadata(spark, sf_dir):
    return build_index(names(spark, sf_dir), "csa", STEP).metadata()


@query
def qgram_intervals_k3(spark, sf_dir):
    return X.prefix_intervals(names(spark, sf_dir), 3)


@query
def index_stats(spark, sf_dir):
    return R.statistics(name_runs(spark, sf_dir))


@query
def run_length_histogram(spark, sf_dir):
    return R.run_length_histogram(name_runs(spark, sf_dir))


@query
def run_blocks(spark, sf_dir):
    return R.blocks(name_runs(spark, sf_dir), 64).groupBy("text_id", "block").agg(F.count("*").alias("runs"))


@query
def overlap_stats(spark, sf_dir):
    return S.overlaps(name_runs(spark, sf_dir))


@query
def head_subsample(spark, sf_dir):
    return S.head_samples(name_runs(spark, sf_dir), STEP)


@query
def phi_blocks(spark, sf_dir):
    return S.phi_blocks(name_runs(spark, sf_dir), STEP)


@query
def phi_blocks_circular(spark, sf_dir):
    return S.phi_blocks(name_runs(spark, sf_dir), STEP, circular=True)


@query
def document_size_histogram(spark, sf_dir):
    return statistics.histogram(_table(spark, sf_dir, "documents").select(F.octet_length("text").alias("size")), "size")


@query
def price_extremes(spark, sf_dir):
    return statistics.extremes(_table(spark, sf_dir, "part"), ["p_type"], "p_retailprice")


@query
def document_index_stats(spark, sf_dir):
    return R.statistics(X.sorted_runs(documents(spark, sf_dir)))


@query
def locate_by_samples(spark, sf_dir):
    return build_index(names(spark, sf_dir), "csa", STEP).locate(name_patterns(spark, sf_dir), "samples")


@query
def locate_all_samples(spark, sf_dir):
    return build_index(names(spark, sf_dir), "rindex").locate(name_patterns(spark, sf_dir), "phi")


@query
def locate_downwards(spark, sf_dir):
    return build_index(names(spark, sf_dir), "rindex").locate(name_patterns(spark, sf_dir), "down")


@query
def count_with_tail(spark, sf_dir):
    return build_index(names(spark, sf_dir), "rindex").count_with_tail(name_patterns(spark, sf_dir))


@query
def locate_in_strings(spark, sf_dir):
    found = build_index(names(spark, sf_dir), "csa", STEP).locate(name_patterns(spark, sf_dir))
    return U.in_strings(found.select("pat_id", "text_id", "pos"), name_ranges(spark, sf_dir)).select("pat_id", "string_id", "offset")


@query
def run_of_position(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.run_of_position(found, _places(found, beyond=1))


@query
def run_range(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    probes = found.select("text_id", "run_id").unionByName(found.groupBy("text_id").agg(F.count("*").alias("run_id")))
    return Q.run_range(found, probes)


@query
def break_range(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.break_range(found, _symbol_ranges(found), 64)


@query
def closest_run_break(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return Q.closest_break(found, _symbol_ranges(found))


@query
def suffix_array_from_transform(spark, sf_dir):
    return X.from_runs(name_runs(spark, sf_dir)).select("text_id", "i", "pos")


@query
def run_samples_from_transform(spark, sf_dir):
    return X.sampled_runs(name_runs(spark, sf_dir)).select("text_id", "run_id", "head_sa", "tail_sa", "rank_before")


@query
def required_subsample(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    return S.head_samples(found, STEP, found.filter("len >= 4"), backward=True)


@query
def phi_steps(spark, sf_dir):
    found = name_runs(spark, sf_dir)
    blocks = S.phi_blocks(found, STEP)
    return U.follow(blocks, _places(found, "pos").withColumn("steps", F.lit(3)))


@query
def psi_runs(spark, sf_dir):
    return X.psi_runs(name_suffixes(spark, sf_dir))


@query
def psi_lookup(spark, sf_dir):
    return X.psi_lookup(X.psi_runs(name_suffixes(spark, sf_dir)), _places(name_runs(spark, sf_dir)))


@query
def psi_range(spark, sf_dir):
    return X.psi_range(X.psi_runs(name_suffixes(spark, sf_dir)), _symbol_ranges(name_runs(spark, sf_dir)))
