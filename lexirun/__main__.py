"""Command line: python -m lexirun build TEXTS INDEX | count INDEX PATTERNS | locate INDEX PATTERNS [--out DIR] | breakdown INDEX.

TEXTS: files, each one text, with --strings a text file with one text per line, or with --transform the file of a
transform, whose samples may be in two more (--heads, --tails). PATTERNS: a pattern file. count and locate print a
header and a row of statistics; locate writes its rows to --out as Parquet. breakdown prints what each table takes.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.suffixsort import SORTERS
from .plans.index import LEVELS, STRATEGIES, build_index, index_from_files, load_index
from .sources import formats


def read_texts(spark: SparkSession, path: str, strings: bool) -> DataFrame:
    """text_id, bytes; a line's id rises with its place, a file's is a hash of its path."""
    if strings:
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("text_id"), F.encode("value", "utf-8").alias("bytes"))
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("text_id"), F.col("content").alias("bytes"))


def stored_bits(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return 8 * where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def report(spark: SparkSession, args: argparse.Namespace) -> dict[str, object]:
    """Answers one batch and returns its statistics."""
    index, patterns = load_index(spark, args.index), formats.read_patterns(spark, args.patterns).cache()
    n = index.metadata().first().n
    shape = patterns.agg(F.count("*").alias("n"), F.avg(F.octet_length("pattern")).alias("m")).first()
    began = time.perf_counter()
    if args.command == "count":
        occurrences = index.count(patterns).agg(F.coalesce(F.sum(F.col("r") - F.col("l") + 1), F.lit(0))).first()[0]
    else:
        found = index.locate(patterns, args.strategy)
        if args.out:
            found.write.parquet(args.out)
            found = spark.read.parquet(args.out)
        occurrences = found.count()
    ns = (time.perf_counter() - began) * 1e9
    return {
        "index": args.index, "level": index.level, "bits_per_symbol": round(stored_bits(spark, args.index) / max(n, 1), 3), "n_pats": shape.n, "pat_len": shape.m,
        "n_occ": occurrences, "ns_per_pat": round(ns / max(shape.n, 1), 1), "ns_per_occ": round(ns / max(occurrences, 1), 1),
    }


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexirun", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("texts")
    build.add_argument("index")
    build.add_argument("--level", choices=LEVELS, default="csa")
    build.add_argument("--step", type=int, default=8)
    build.add_argument("--sorter", choices=list(SORTERS), default="doubling")
    build.add_argument("--strings", action="store_true")
    build.add_argument("--transform", choices=list(formats.BWT_FORMATS))
    build.add_argument("--heads")
    build.add_argument("--tails")
    for name in ("count", "locate"):
        ask = commands.add_parser(name)
        ask.add_argument("index")
        ask.add_argument("patterns")
        ask.add_argument("--out")
        ask.add_argument("--strategy", choices=list(STRATEGIES))
    commands.add_parser("breakdown").add_argument("index")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lexirun").getOrCreate()
    if args.command == "build":
        if args.transform:
            index_from_files(spark, args.texts, args.transform, args.heads, args.tails, args.level, args.step).save(args.index)
        else:
            build_index(read_texts(spark, args.texts, args.strings), args.level, args.step, args.sorter).save(args.index)
        return
    if args.command == "breakdown":
        rows = load_index(spark, args.index).space()
        print("\t".join(rows.columns), *("\t".join(map(str, r)) for r in rows.collect()), sep="\n", file=sys.stdout)
        return
    row = report(spark, args)
    print("\t".join(row), "\t".join(map(str, row.values())), sep="\n", file=sys.stdout)


if __name__ == "__main__":
    main()
