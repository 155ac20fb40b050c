"""Articles with reference summaries -> detail table -> report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kurzwerk.functions import text as X
from kurzwerk.operators import evaluation as E
from kurzwerk.operators import summarize as S
from kurzwerk.params import Params
from kurzwerk.session import remove_work, work_dir
from kurzwerk.sources import corpus, reports


def examples_of(
    articles: DataFrame,
    key: str = "example_id",
    params: Params = Params(),
    load: Callable[..., S.Model] | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """``key, reference, input_characters, generated, error, elapsed`` of every article.

    Articles are cut to ``eval_article_chars`` characters if that is set. Without
    ``load`` the extractive default is used, row by row. A failed example has an
    ``error`` and no generated text. Nothing is joined: what the scores need goes
    through the summary.
    """
    article = F.col("article")
    if params.eval_article_chars is not None:
        article = X.truncate_chars(article, params.eval_article_chars)
    carry = ["reference", "input_characters"]
    rows = articles.select(
        key,
        "reference",
        X.n_chars(F.col("article")).alias("input_characters"),
        article.alias("chunk"),
    )
    limits = params.eval_max_summary_tokens, params.eval_min_summary_tokens
    if load is None:
        done = S.summarize_chunks(rows, [key, *carry], "chunk", *limits)
    else:
        done = S.map_summarizer(
            rows, load, model_name or params.model_name, [key], "chunk", params=params,
            carry=carry, max_tokens=limits[0], min_tokens=limits[1],
        )
    generated = F.when(F.col("error").isNull(), F.coalesce("summary", F.lit("")))
    return done.select(key, *carry, generated.alias("generated"), "error", "elapsed")


class ExamplesFailed(RuntimeError):
    """Some examples of an evaluation have no summary."""


def detail_of(
    articles: DataFrame,
    key: str = "example_id",
    params: Params = Params(),
    stem: bool = True,
    load: Callable[..., S.Model] | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """The detail table, with the ``error`` of failed examples (their figures are null)."""
    return E.evaluation_detail(examples_of(articles, key, params, load, model_name), key, stem)


def evaluate(
    articles: DataFrame,
    dataset: str,
    output: str | None = None,
    key: str = "example_id",
    num_samples: int | None = Params().eval_num_samples,
    model_name: str | None = None,
    params: Params = Params(),
    stem: bool = True,
    load: Callable[..., S.Model] | None = None,
    allow_failed: bool = False,
) -> DataFrame:
    """Score ``key, article, reference`` rows and return the one-row report.

    ``dataset`` is the name the report gives them. ``num_samples`` keeps the first
    articles in key order; None keeps all. Without ``load`` the report names the
    extractive default. If an example fails, ``ExamplesFailed`` is raised; with
    ``allow_failed``, failed examples take no part in the means and are counted as
    ``n_failed``. The detail table is written before the report is computed from it,
    because the quantile reads it several times, and removed afterwards. With
    ``output``, ``<output>.json`` and ``<output>.csv`` are written too.
    """
    spark = articles.sparkSession
    name = S.EXTRACTIVE if load is None else model_name or params.model_name
    if num_samples is not None:
        articles = corpus.sample(articles, key, num_samples)
    place = work_dir(spark, "evaluation-detail")
    try:
        detail = reports.materialize(
            detail_of(articles, key, params, stem, load, name), place
        )
        first = detail.filter(F.col("error").isNotNull()).select("error").first()
        if first and not allow_failed:
            n = detail.filter(F.col("error").isNotNull()).count()
            raise ExamplesFailed(f"{n} of {detail.count()} examples failed: {first.error}")
        report = E.evaluation_report(detail, name, dataset)
        # One row; with it the report no longer needs the table.
        report = spark.createDataFrame(report.collect(), report.schema)
        if output:
            reports.write_evaluation(detail, report, output)
        return report
    finally:
        remove_work(spark, place)
