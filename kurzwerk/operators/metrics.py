"""Ordered merge of partial summaries and the figures of a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kurzwerk import params as P
from kurzwerk.functions import text as X

BLOCK = 1024


def covered_words(vocabulary: Column, words: Column) -> Column:
    """How many of ``words`` occur as character runs in the source's words.

    A word is covered when it is a substring of some source word; runs of several
    words never change the count. Words found by hash lookup are settled first,
    only the distinct others are searched for.
    """
    parts = F.struct(vocabulary.alias("source"), words.alias("words"))

    def count(p: Column) -> Column:
        unknown = F.array_except(p["words"], p["source"])
        missing = X.let(
            F.array_join(p["source"], " "),
            lambda joined: F.filter(unknown, lambda w: ~F.contains(joined, w)),
        )
        uncovered = X.let(
            missing,
            lambda m: F.when(F.size(m) == 0, 0).otherwise(
                F.size(F.filter(p["words"], lambda w: F.array_contains(m, w)))
            ),
        )
        return F.size(p["words"]) - uncovered

    return X.let(parts, count).cast("bigint")


def coverage(covered: Column, n_words: Column) -> Column:
    """Extractive coverage, 2 digits; 0 for an empty summary."""
    return F.when(n_words == 0, 0.0).otherwise(X.python_round(covered / n_words, 2))


def compression_rate(summary_characters: Column, input_characters: Column) -> Column:
    """Summary to input characters, 3 digits; 0 for an empty input."""
    return F.when(input_characters == 0, 0.0).otherwise(
        X.python_round(summary_characters / input_characters, 3)
    )


def distinct_words(joined: Column) -> Column:
    """Aggregate: the distinct words of texts whose words are parted by single spaces."""
    words = F.split(F.array_join(F.collect_list(joined), " "), " ")
    return F.array_remove(F.array_distinct(words), "")


def merge_summaries(
    results: DataFrame, keys: Sequence[str] = ("doc_id",), source_words: bool = True
) -> DataFrame:
    """Chunk results -> one row per document.

    Expects ``chunk_no, chunk, summary, model_name, error, elapsed`` and maybe
    ``truncated``. Gives ``summary, model_name, n_chunks, n_failed, error,
    truncated, input_characters, elapsed`` and, with ``source_words``, the distinct
    words of the source. One failed chunk fails the document (summary null); its
    error is that of the first failed chunk. Blocks of consecutive chunks are merged
    before whole documents, so a document with very many chunks is spread.
    """
    block = F.floor(F.col("chunk_no") / BLOCK)
    cut = F.col("truncated") if "truncated" in results.columns else F.lit(False)
    failed_at = F.when(F.col("error").isNotNull(), F.col("chunk_no"))
    partial = X.strip(F.coalesce("summary", F.lit("")))
    named = F.when(F.col("model_name").isNotNull(), F.col("chunk_no"))
    first = [
        F.expr("listagg(_partial, ' ') WITHIN GROUP (ORDER BY chunk_no)").alias("_merged"),
        F.max_by("model_name", "_named").alias("_model"),
        F.max("_named").alias("_named"),
        F.count("*").alias("_n"),
        F.count("error").alias("_failed"),
        F.min_by("error", "_failed_at").alias("_error"),
        F.min("_failed_at").alias("_failed_at"),
        F.coalesce(F.bool_or(cut), F.lit(False)).alias("_cut"),
        F.sum(X.n_chars(F.col("chunk"))).alias("_chars"),
        F.sum("elapsed").alias("_elapsed"),
    ]
    last = [
        F.expr("listagg(_merged, ' ') WITHIN GROUP (ORDER BY _block)").alias("_summary"),
        F.coalesce(F.max_by("_model", "_named"), F.lit("unknown")).alias("model_name"),
        F.sum("_n").alias("n_chunks"),
        F.sum("_failed").alias("n_failed"),
        F.min_by("_error", "_failed_at").alias("error"),
        F.bool_or("_cut").alias("truncated"),
        F.sum("_chars").alias("input_characters"),
        F.sum("_elapsed").alias("elapsed"),
    ]
    if source_words:
        # Words meet as one text per row: an array of them takes thrice the bytes.
        words = F.array_join(F.array_distinct(X.word_tokens(F.col("chunk"))), " ")
        first.append(F.array_join(distinct_words(words), " ").alias("_words"))
        last.append(distinct_words(F.col("_words")).alias("source_words"))
    merged = (
        results.withColumn("_block", block)
        .withColumn("_partial", partial)
        .withColumn("_named", named)
        .withColumn("_failed_at", failed_at)
        .groupBy(*keys, "_block")
        .agg(*first)
        .groupBy(*keys)
        .agg(*last)
    )
    return merged.select(
        *keys,
        F.when(F.col("n_failed") == 0, X.strip(F.col("_summary"))).alias("summary"),
        "model_name",
        "n_chunks",
        "n_failed",
        "error",
        "truncated",
        "input_characters",
        X.python_round(F.col("elapsed"), 2).alias("elapsed"),
        *(["source_words"] if source_words else []),
    )


def merge_arrays(done: DataFrame, keys: Sequence[str], model_name: str) -> DataFrame:
    """As ``merge_summaries``, for rows that hold all chunks and partials as arrays."""
    stripped = F.transform("partials", lambda p: X.strip(F.coalesce(p, F.lit(""))))
    return done.select(
        *keys,
        X.strip(F.array_join(stripped, " ")).alias("summary"),
        F.lit(model_name).alias("model_name"),
        F.size("chunks").cast("bigint").alias("n_chunks"),
        F.lit(0).cast("bigint").alias("n_failed"),
        F.lit(None).cast("string").alias("error"),
        F.lit(False).alias("truncated"),
        F.aggregate(
            "chunks", F.lit(0).cast("bigint"), lambda total, c: total + F.length(c)
        ).alias("input_characters"),
        X.python_round(F.col("elapsed"), 2).alias("elapsed"),
        F.array_distinct(X.word_tokens(F.array_join("chunks", " "))).alias("source_words"),
    )


def document_record(merged: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The result record of every document, with display texts."""
    failed = F.col("n_failed") > 0
    figures = merged.withColumn("_summary_words", X.word_tokens(F.col("summary")))
    figures = figures.select(
        *keys,
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, F.lit(P.MSG_SERVICE_PREFIX + P.MSG_SERVICE_DOWN)).alias("message"),
        "error",
        "truncated",
        "summary",
        "model_name",
        F.col("elapsed").alias("processing_time_seconds"),
        "input_characters",
        X.n_chars(F.col("summary")).alias("summary_characters"),
        "n_chunks",
        covered_words(F.col("source_words"), F.col("_summary_words")).alias("covered_words"),
        F.size("_summary_words").cast("bigint").alias("summary_words"),
    )
    return figures.withColumn(
        "extractive_coverage", coverage(F.col("covered_words"), F.col("summary_words"))
    ).withColumn(
        "compression_rate",
        compression_rate(F.col("summary_characters"), F.col("input_characters")),
    ).withColumn("coverage_text", X.percent_text(F.col("extractive_coverage")))
