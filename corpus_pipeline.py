"""A corpus, from raw documents to token ids, in five stages; each reads what the one before it wrote.

Every stage is one operator of lexirun.llm: documents found toxic go; of exact copies the one with the largest id
stays; of each group of similar documents the one with the smallest id stays; documents that hold a benchmark
passage go; the rest is encoded, and every piece keeps the span of bytes that it came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexirun.llm import decontaminate, exact_dedup, jaccard_join, pieces, toxicity
from lexirun.llm.common import cut, discard, scratch, table
from lexirun.llm.queries import tokenizer_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_similar(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, tokenizer_path(), ("n_tokens", "ids", "spans", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", copies_out),
    ("ngram_jaccard_join", one_of_similar),
    ("benchmark_decontamination", benchmark_out),
    ("sentencepiece", encoded),
]

#: SQL can't express the classifier, the SimHash index or the encoder; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables go when its result is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch() as keep:
            docs = cut(stage(spark, docs, sf_dir))
            keep(docs)
        if before is not None:
            discard(before)
        before = docs
