"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, BPE encoding.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and writes Parquet that the next one reads.

Defined results: null and empty texts fail the quality rules and go; rows that repeat id and text are one document in line dedup and the
join, of which one stays; rows without an id take part by their content; no rows give none, and no benchmark rows drop none; other
columns pass through all stages but the last unchanged, whatever their names.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from reachforge.llm import bpe_codec, decontaminate, line_dedup, ngram_join, quality_rules
from reachforge.llm.common import read, remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and documents that are nothing but such copies."""
    return line_dedup.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their digests."""
    return bpe_codec.encode_documents(docs, keep_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("bpe encoding", encoding)]

#: SQL can express neither the fit of the quality rules nor string tiling nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:  # what the stage read is not needed any more
            remove(spark, f"{base}/{k - 1}")
    return docs
