"""A corpus pipeline of the operators: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kurzwerk.llm import byte_bpe, decontaminate, near_dedup, quality, suffix_dedup
from kurzwerk.llm.common import read_table, stored
from kurzwerk.llm.queries import vocabulary
from kurzwerk.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship_package(spark)
    return quality.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class."""
    ship_package(spark)
    return near_dedup.one_of_each(docs)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes that occur elsewhere too."""
    ship_package(spark)
    return suffix_dedup.without_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item appears."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    ship_package(spark)
    return byte_bpe.digests(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeated_string_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: The stages hash, sketch and encode; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
