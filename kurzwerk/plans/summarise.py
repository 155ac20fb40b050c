"""Documents -> clean text -> chunks -> partial summaries -> one result record per document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kurzwerk.functions import text as X
from kurzwerk.functions.tokens import TokenCounter
from kurzwerk.operators import chunking as C
from kurzwerk.operators import metrics as M
from kurzwerk.operators import summarize as S
from kurzwerk.params import Params


def clean_documents(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys, text`` cleaned, without the documents that have no text.

    The test looks at the raw text, so the filter is cheap wherever Spark moves it
    and the text is not cleaned twice. Cleaning clean text changes nothing.
    """
    seen = docs.filter(X.is_visible(F.col("text")))
    return seen.select(*keys, X.clean_text(F.col("text")).alias("text"))


def summarise_documents(
    docs: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    params: Params = Params(),
    counter: TokenCounter | None = None,
) -> DataFrame:
    """Result records with the extractive default, row by row: no shuffle."""
    arrays = C.chunk_arrays(
        clean_documents(docs, keys), keys, "text", params.max_tokens, params.overlap_tokens, counter
    )
    done = S.extractive_arrays(
        arrays, keys, params.max_summary_tokens, params.min_summary_tokens
    )
    return M.document_record(M.merge_arrays(done, keys, S.EXTRACTIVE), keys)


def summarise_with_model(
    docs: DataFrame,
    load: Callable[[], S.Model],
    keys: Sequence[str] = ("doc_id",),
    params: Params = Params(),
    counter: TokenCounter | None = None,
    tasks: int | None = None,
    batch_size: int = 32,
) -> DataFrame:
    """Result records with a user's model, which gets the chunks of all documents spread."""
    chunks = C.chunk_text(
        clean_documents(docs, keys), keys, "text", params.max_tokens, params.overlap_tokens, counter
    )
    results = S.map_summarizer(
        chunks, load, params.model_name, [*keys, "chunk_no"], "chunk", batch_size, tasks, params
    )
    return M.document_record(M.merge_summaries(results, keys), keys)
