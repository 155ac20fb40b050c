"""Page texts -> document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kurzwerk.functions import text as X


def join_pages(pages: Column) -> Column:
    """Text of an ARRAY<STRING> of pages: failed (null) pages count as empty."""
    return X.strip(
        F.array_join(F.transform(pages, lambda p: F.coalesce(p, F.lit(""))), "\n")
    )


def assemble_pages(
    pages: DataFrame,
    doc: str = "doc_id",
    page_no: str = "page_no",
    text: str = "text",
) -> DataFrame:
    """One row per document from one row per page; a failed page has a null text.

    Result: ``doc, text, num_pages, num_characters, n_page_errors, has_text``. There
    is no limit of pages here; the text of a document is one value, whatever its size.
    """
    return (
        pages.groupBy(doc)
        .agg(
            F.count("*").alias("num_pages"),
            F.count_if(F.col(text).isNull()).alias("n_page_errors"),
            F.expr(
                f"listagg(coalesce(`{text}`, ''), '\n') WITHIN GROUP (ORDER BY `{page_no}`)"
            ).alias("_joined"),
        )
        .withColumn("text", X.strip(F.col("_joined")))
        .select(
            doc,
            "text",
            "num_pages",
            X.n_chars(F.col("text")).alias("num_characters"),
            "n_page_errors",
            (F.col("text") != "").alias("has_text"),
        )
    )
