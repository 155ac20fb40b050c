"""Checks on uploaded files and extracted documents; the first failing one decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kurzwerk import params as P
from kurzwerk.functions import text as X
from kurzwerk.params import Params


def decode_data_url(contents: Column) -> Column:
    """Bytes after the first comma of ``data:<mime>;base64,<payload>``, null if undecodable.

    Characters outside the base64 alphabet are skipped; non-ASCII ones, a
    missing comma and wrong padding are refused.
    """
    comma = F.instr(contents, ",")
    foreign = "[^A-Za-z0-9+/=]+"

    def lenient(payload: Column) -> Column:
        return X.let(
            F.regexp_replace(payload, foreign, ""),
            lambda c: F.when(
                c.rlike(r"\A[A-Za-z0-9+/]*+={0,2}\z")
                & (F.length(c) % 4 == 0)
                & ~payload.rlike(r"[^\x00-\x7F]"),
                F.unbase64(c),
            ),
        )

    def decode(payload: Column) -> Column:
        # The strict decoder settles well-formed payloads without any regex; it
        # would also take unpadded ones, hence the comparison of the lengths.
        size = F.length(F.translate(payload, " \t\r\n", ""))
        return X.let(
            F.try_to_binary(payload, F.lit("base64")),
            lambda strict: F.when(
                strict.isNotNull() & (size == 4 * F.ceil(F.octet_length(strict) / 3)), strict
            ).otherwise(lenient(payload)),
        )

    return F.when(comma > 0, X.let(F.substr(contents, comma + 1), decode))


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows where an input is absent: they give no outcome at all."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return df.filter(condition)


def non_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """Requests need at least one character."""
    return df.filter(F.length(text) >= 1)


def file_reason(
    filename: Column, size: Column, decodable: Column, params: Params
) -> Column:
    """Reason a file is refused before extraction, else null."""
    return (
        F.when(~decodable, "undecodable")
        .when(~F.lower(filename).endswith(params.allowed_extension), "extension")
        .when(size == 0, "empty")
        .when(size > params.max_file_size, "oversize")
    )


def document_reason(
    failed: Column, has_text: Column, num_pages: Column, params: Params
) -> Column:
    """Reason an extracted document is not ready, else null."""
    return (
        F.when(failed, "unreadable")
        .when(~has_text, "no_text")
        .when(num_pages > params.max_pages, "page_cap")
    )


def status(reason: Column) -> Column:
    return (
        F.when(reason.isNull(), "success").when(reason == "page_cap", "warning").otherwise("error")
    )


def message(
    reason: Column, filename: Column, num_pages: Column, num_characters: Column, params: Params
) -> Column:
    """The text shown for an outcome."""
    invalid = {
        "undecodable": F.lit(P.MSG_UNDECODABLE),
        "extension": F.format_string(P.MSG_EXTENSION, filename),
        "empty": F.lit(P.MSG_EMPTY),
        "oversize": F.lit(P.MSG_OVERSIZE % params.size_limit_text),
    }
    unreadable = {"unreadable": P.MSG_UNREADABLE, "no_text": P.MSG_NO_TEXT}
    chosen = F.when(
        reason == "page_cap",
        F.format_string(P.MSG_PAGE_CAP, num_pages.cast("string"), F.lit(str(params.max_pages))),
    )
    for name, text in invalid.items():
        chosen = chosen.when(reason == name, F.concat(F.lit(P.MSG_INVALID_PREFIX), text))
    for name, text in unreadable.items():
        chosen = chosen.when(reason == name, F.lit(P.MSG_ERROR_PREFIX + text))
    return chosen.otherwise(
        F.format_string(
            P.MSG_SUCCESS,
            filename,
            num_pages.cast("string"),
            num_characters.cast("string"),
        )
    )


def with_outcome(df: DataFrame, params: Params) -> DataFrame:
    """Add ``status, message, ready`` and the cleaned ``text`` of accepted documents.

    Expects ``filename, reason, text, num_pages, num_characters``.
    """
    reason = F.col("reason")
    ready = reason.isNull()
    return (
        df.withColumn("status", status(reason))
        .withColumn(
            "message",
            message(
                reason, F.col("filename"), F.col("num_pages"), F.col("num_characters"), params
            ),
        )
        .withColumn("text", F.when(ready, X.clean_text(F.col("text"))))
        .withColumn("ready", ready)
    )


def accepted(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("status") == "success")


def quarantined(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("status") != "success")
