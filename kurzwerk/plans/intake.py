"""Uploads -> outcomes with clean text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kurzwerk.functions import text as X
from kurzwerk.operators import pages as PG
from kurzwerk.operators import validation as V
from kurzwerk.params import Params
from kurzwerk.sources.uploads import Extractor


def decode_uploads(uploads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, filename, contents`` (data URLs) -> ``keys, filename, size, content, decodable``.

    Rows without contents or filename have no outcome and are dropped.
    """
    content = V.decode_data_url(F.col("contents"))
    return (
        V.present(uploads, "filename", "contents")
        .select(*keys, "filename", content.alias("content"))
        .withColumn("size", F.octet_length("content").cast("bigint"))
        .withColumn("decodable", F.col("content").isNotNull())
    )


def classify_files(
    files: DataFrame,
    extractor: Extractor,
    params: Params = Params(),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Status, message and clean text of every file; row by row, no shuffle.

    Expects ``keys, filename, size, content`` and optionally ``decodable``. Files
    that fail a cheap check reach the extractor as null.
    """
    decodable = F.col("decodable") if "decodable" in files.columns else F.lit(True)
    early = V.file_reason(F.col("filename"), F.col("size"), decodable, params)
    extracted = (
        files.withColumn("_early", early)
        .withColumn("_content", F.when(F.col("_early").isNull(), F.col("content")))
        .select(*keys, "filename", "_early", extractor(F.col("_content")).alias("_x"))
        .select(
            *keys,
            "filename",
            "_early",
            F.col("_x.error").alias("_error"),
            F.size("_x.pages").cast("bigint").alias("num_pages"),
            PG.join_pages(F.col("_x.pages")).alias("text"),
        )
        .withColumn("num_characters", X.n_chars(F.col("text")))
    )
    late = V.document_reason(
        F.col("_error").isNotNull(),
        F.coalesce(F.col("text") != "", F.lit(False)),
        F.col("num_pages"),
        params,
    )
    reason = F.when(F.col("_early").isNotNull(), F.col("_early")).otherwise(late)
    return V.with_outcome(extracted.withColumn("reason", reason), params).select(
        *keys,
        "filename",
        "status",
        "reason",
        "message",
        "text",
        "num_pages",
        "num_characters",
        "ready",
    )


def classify_uploads(
    uploads: DataFrame,
    extractor: Extractor,
    params: Params = Params(),
    keys: Sequence[str] = (),
) -> DataFrame:
    """``classify_files`` for data URLs."""
    return classify_files(decode_uploads(uploads, keys), extractor, params, keys)


def classify_pages(
    pages: DataFrame,
    params: Params = Params(),
    doc: str = "doc_id",
    page_no: str = "page_no",
    text: str = "text",
    filename: str | None = None,
) -> DataFrame:
    """Outcomes of documents given as page rows (already extracted files).

    A document above the page limit keeps its counts; its text is withheld.
    """
    return classify_documents(PG.assemble_pages(pages, doc, page_no, text), params, doc, filename)


def classify_documents(
    docs: DataFrame,
    params: Params = Params(),
    doc: str = "doc_id",
    filename: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Outcomes of the rows of ``assemble_pages``; row by row."""
    reason = V.document_reason(
        F.lit(False), F.col("has_text"), F.col("num_pages"), params
    )
    named = docs.withColumn("filename", F.col(filename or doc).cast("string")).withColumn(
        "reason", reason
    )
    return V.with_outcome(named, params).select(
        doc,
        "status",
        "reason",
        "message",
        "text",
        "num_pages",
        "num_characters",
        "n_page_errors",
        "ready",
        *carry,
    )
