"""Documents -> overlapping, token-bounded chunks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kurzwerk.functions import text as X
from kurzwerk.functions.batches import release
from kurzwerk.functions.tokens import TokenCounter, Units, like

SLICES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("hard", pa.bool_())]))


def pack(counts: Sequence[int], max_tokens: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Slice bounds ``(a, b, hard)`` over the sentences, from their token counts alone.

    Sentences above ``max_tokens`` are slices of their own (``hard``) and take no
    part in the others. With running sums over the rest, "the buffer is full" and
    "how far back does the overlap reach" are a difference and a binary search.
    """
    fits = [n <= max_tokens for n in counts]
    tokens = [0, *accumulate(n if ok else 0 for n, ok in zip(counts, fits))]
    alive = [0, *accumulate(fits)]
    slices: list[tuple[int, int, bool]] = []
    start = 0
    for k, n in enumerate(counts):
        if tokens[k] - tokens[start] + n > max_tokens and alive[k] > alive[start]:
            slices.append((start, k, False))
            start = bisect_left(tokens, tokens[k] - overlap, start, k)
        if not fits[k]:
            slices.append((k, k + 1, True))
    if alive[-1] > alive[start]:
        slices.append((start, len(counts), False))
    return slices


def packed(rows: pa.Array, max_tokens: int, overlap: int) -> pa.Array:
    """``pack`` of every row of a list array of token counts."""
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(lengths)])
    ends, a, b, hard = [0], [], [], []
    for begin, end in zip(at, at[1:]):
        for first, last, single in pack(flat[begin:end].tolist(), max_tokens, overlap):
            a.append(first)
            b.append(last)
            hard.append(single)
        ends.append(len(a))
    bounds = pa.StructArray.from_arrays(
        [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(hard, pa.bool_())],
        fields=list(SLICES.value_type),
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), bounds)


def slice_bounds(counts: Column, max_tokens: int, overlap: int) -> Column:
    """``pack`` over an ARRAY<INT> column; only the integers travel to Python.

    Declared as not deterministic, so that Spark never moves it into the expressions
    (and lambdas) built on its result.
    """

    @F.arrow_udf("array<struct<a:int,b:int,hard:boolean>>")
    def bounds(rows: pa.Array) -> pa.Array:
        return packed(rows, max_tokens, overlap)

    return bounds.asNondeterministic()(counts)


def cuts_in_worker(
    sentences: Column, counter: TokenCounter, max_tokens: int, overlap: int
) -> Column:
    """STRUCT(counts, slices, pieces) of a counter that works in Python, in one step.

    Steps of their own would each hold a worker, with its tokenizer, next to the others.
    """

    @F.arrow_udf(
        "struct<counts:array<int>,slices:array<struct<a:int,b:int,hard:boolean>>,"
        "pieces:array<array<string>>>"
    )
    def cuts(rows: pa.Array) -> pa.Array:
        flat = rows.flatten()
        sizes = counter.sizes(flat)
        counts = like(rows, sizes)
        parts: list = [None] * len(flat)
        for i in np.flatnonzero(sizes.to_numpy() > max_tokens).tolist():
            parts[i] = counter.parts(flat[i].as_py(), max_tokens)
        pieces = like(rows, pa.array(parts, pa.list_(pa.string())))
        columns = [counts, packed(counts, max_tokens, overlap), pieces]
        release()
        return pa.StructArray.from_arrays(columns, ["counts", "slices", "pieces"])

    return cuts.asNondeterministic()(sentences)


def _texts(
    sentences: Column, counts: Column, pieces: Column, slices: Column, max_tokens: int
) -> Column:
    """Chunk texts of one document; nulls in the sentence list vanish when joined."""
    fitting = F.zip_with(sentences, counts, lambda s, n: F.when(n <= max_tokens, s))

    def cut(parts: Column) -> Column:
        def one(c: Column) -> Column:
            packed = F.array_join(F.slice(parts["fit"], c["a"] + 1, c["b"] - c["a"]), " ")
            return F.when(c["hard"], F.get(parts["hard"], c["a"])).otherwise(F.array(packed))

        return F.flatten(F.transform(slices, one))

    texts = X.let(F.struct(fitting.alias("fit"), pieces.alias("hard")), cut)
    return F.filter(F.transform(texts, X.strip), lambda c: F.length(c) > 0)


def chunk_arrays(
    docs: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    max_tokens: int = 900,
    overlap_tokens: int = 50,
    counter: TokenCounter | None = None,
) -> DataFrame:
    """``keys, chunks ARRAY<STRING>``: one row per document, no shuffle.

    A text of at most ``max_tokens`` is its own single chunk, unchanged.
    """
    counter = counter or Units()
    none = F.array().cast("array<string>")
    is_long = F.col("_n") > max_tokens
    rows = docs.select(
        *keys, F.col(text).alias("_text"), counter.count(F.col(text)).alias("_n")
    ).withColumn("_s", F.when(is_long, X.sentences(F.col("_text"))).otherwise(none))
    if hasattr(counter, "parts"):
        cuts = cuts_in_worker(F.col("_s"), counter, max_tokens, overlap_tokens)
        rows = rows.withColumn("_cuts", cuts)
        c, b, p = (F.col(f"_cuts.{part}") for part in ("counts", "slices", "pieces"))
    else:
        rows = (
            rows.withColumn("_c", counter.counts(F.col("_s")))
            .withColumn("_b", slice_bounds(F.col("_c"), max_tokens, overlap_tokens))
            .withColumn("_long", F.zip_with("_s", "_c", lambda s, n: F.when(n > max_tokens, s)))
            .withColumn("_p", counter.pieces(F.col("_long"), max_tokens))
        )
        c, b, p = F.col("_c"), F.col("_b"), F.col("_p")
    return rows.select(
        *keys,
        F.when(is_long, _texts(F.col("_s"), c, p, b, max_tokens))
        .otherwise(F.array("_text"))
        .alias("chunks"),
    )


def chunk_text(
    docs: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    max_tokens: int = 900,
    overlap_tokens: int = 50,
    counter: TokenCounter | None = None,
) -> DataFrame:
    """``keys, chunk_no, chunk``: one row per chunk in document order."""
    arrays = chunk_arrays(docs, keys, text, max_tokens, overlap_tokens, counter)
    return explode_chunks(arrays, keys)


def explode_chunks(arrays: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows from the arrays. The outer form keeps Spark from evaluating them twice."""
    return arrays.select(*keys, F.posexplode_outer("chunks").alias("chunk_no", "chunk")).filter(
        F.col("chunk").isNotNull()
    )


def chunk_counts(chunks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Chunks and characters per document from a chunk table."""
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("n_chunks"), F.sum(X.n_chars(F.col("chunk"))).alias("input_characters")
    )
