"""Scores per example and the corpus report."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kurzwerk import params as P
from kurzwerk.functions import text as X
from kurzwerk.operators.rouge import rouge_scores

# Column order of the detail table.
DETAIL = [
    "rouge1_f",
    "rouge2_f",
    "rougeL_f",
    "processing_time_seconds",
    "compression_rate",
    "input_characters",
    "summary_characters",
]


def evaluation_detail(
    examples: DataFrame, key: str = "example_id", stem: bool = True
) -> DataFrame:
    """One row per example from ``key, reference, generated, input_characters, elapsed``.

    ``input_characters`` is the length of the full article; the rate is not
    rounded and 0 for an empty article. With a column ``error``, the figures of
    examples that have one are null, and it is handed through.
    """
    errors = ["error"] if "error" in examples.columns else []
    generated = X.n_chars(F.coalesce("generated", F.lit("")))
    rate = F.when(
        F.col("input_characters") > 0, generated / F.col("input_characters")
    ).otherwise(0.0)
    sized = examples.select(
        key,
        "reference",
        "generated",
        F.col("elapsed").alias("processing_time_seconds"),
        rate.alias("compression_rate"),
        "input_characters",
        generated.alias("summary_characters"),
        *errors,
    ).withColumn("generated", F.coalesce("generated", F.lit("")))
    carry = [*DETAIL[3:], *errors]
    scores = rouge_scores(sized, key, "reference", "generated", stem=stem, carry=carry)
    if not errors:
        return scores.select(key, *DETAIL)
    told = [c for c in DETAIL if c != "input_characters"]
    figures = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in told]
    scored = scores.select(key, "input_characters", "error", *figures)
    return scored.select(key, *DETAIL, "error")


def exact_quantile(
    values: DataFrame, column: str, q: float, buckets: int = 65536
) -> float | None:
    """The exact, linearly interpolated quantile of a column; nulls are ignored.

    Each pass counts the values between two bounds in equal-width buckets (on the
    map side first, so at most ``buckets`` rows meet) and brings one row to the
    driver: the buckets of the two wanted ranks. If they differ, the ranks are the
    largest value of the one and the smallest of the other; if not, the next pass
    looks between that bucket's extremes. The least and the greatest value never
    share a bucket, so every pass leaves fewer values. The column is read once per
    pass: give a written table rather than a long plan.
    """
    x = F.col("x")
    values = values.select(F.col(column).cast("double").alias("x")).filter(x.isNotNull())
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if n == 0:
        return None
    lower_rank, upper_rank = math.floor(q * (n - 1)), math.ceil(q * (n - 1))
    below = 0
    running = F.sum("here").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    bucket = F.struct("place", "least", "most", "here", "seen")
    while low < high:
        step = F.least(F.floor((x - low) / (high - low) * buckets), F.lit(buckets - 1))
        lower, upper = (
            values.filter(x.between(low, high))
            .groupBy(step.alias("place"))
            .agg(F.count("*").alias("here"), F.min("x").alias("least"), F.max("x").alias("most"))
            .withColumn("seen", running + below)
            .agg(*[F.min(F.when(F.col("seen") > r, bucket)) for r in (lower_rank, upper_rank)])
            .first()
        )
        if lower.place != upper.place:
            low, high = lower.most, upper.least
            break
        low, high, below = lower.least, lower.most, lower.seen - lower.here
    part = q * (n - 1) - lower_rank
    return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)


def evaluation_report(
    detail: DataFrame,
    model_name: str = P.Params().model_name,
    dataset: str = P.EVAL_DATASET,
) -> DataFrame:
    """The one-row report over a detail table.

    With a column ``error``, examples that have one are left out and counted as
    ``n_failed``.
    """
    failed = []
    if "error" in detail.columns:
        failed = [F.count("error").alias("n_failed")]
        detail = detail.withColumn("_scored", F.col("error").isNull())
    scored = F.col("_scored") if failed else F.lit(True)

    def mean(column: str, digits: int) -> Column:
        return X.python_round(F.avg(column), digits)

    p95 = exact_quantile(detail, "processing_time_seconds", 0.95)
    return detail.agg(
        F.count_if(scored).alias("num_samples"),
        *failed,
        mean("rouge1_f", 4).alias("rouge1_f_mean"),
        mean("rouge2_f", 4).alias("rouge2_f_mean"),
        mean("rougeL_f", 4).alias("rougeL_f_mean"),
        mean("processing_time_seconds", 2).alias("processing_time_seconds_mean"),
        mean("compression_rate", 4).alias("compression_rate_mean"),
    ).withColumn("_p95", F.lit(p95).cast("double")).select(
        F.lit(model_name).alias("model_name"),
        F.lit(dataset).alias("dataset"),
        "num_samples",
        *(["n_failed"] if failed else []),
        "rouge1_f_mean",
        "rouge2_f_mean",
        "rougeL_f_mean",
        "processing_time_seconds_mean",
        X.python_round(F.col("_p95"), 2).alias("processing_time_seconds_p95"),
        "compression_rate_mean",
    )
