"""Per-chunk summaries: a Spark-native extractive default and a hook for a model."""

from __future__ import annotations

import inspect
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kurzwerk import params as P
from kurzwerk.functions import text as X
from kurzwerk.functions.batches import release, runs
from kurzwerk.operators.model_process import ModelProcess, described
from kurzwerk.params import Params

EXTRACTIVE = "extractive-tf"


#: Words that are ranked at a time; a longer row is one step of its own.
RANKED_WORDS = 1 << 17

PICKS = pa.struct([("kept", pa.list_(pa.list_(pa.int32()))), ("elapsed", pa.float64())])


def kept_sentences(chunks: pa.Array, max_tokens: int, min_tokens: int) -> pa.Array:
    """Per row and chunk, the numbers of the sentences to keep, for all rows at once.

    ``chunks`` holds rows of chunks of sentences of words. Frequencies are counted on
    dictionary codes within a chunk; one sort ranks the sentences of all chunks.
    """

    def sizes(lists: pa.Array) -> np.ndarray:
        return pc.list_value_length(lists).to_numpy(zero_copy_only=False)

    sentences = chunks.flatten()
    words = sentences.flatten()
    chunk = np.repeat(np.arange(len(sentences)), sizes(sentences))
    first = np.cumsum(sizes(sentences)) - sizes(sentences)
    number = np.arange(len(words)) - first[chunk]
    n = sizes(words)
    sentence = np.repeat(np.arange(len(words)), n)
    coded = words.flatten().dictionary_encode()
    keys = chunk[sentence] * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    weight = np.bincount(sentence, weights=count[place], minlength=len(words))
    some = np.flatnonzero(n > 0)
    order = some[np.lexsort((number[some], -(weight[some] / n[some]), chunk[some]))]
    running = np.cumsum(n[order])
    opens = np.concatenate([[True], chunk[order][1:] != chunk[order][:-1]])[: len(order)]
    running = running - np.maximum.accumulate(np.where(opens, running - n[order], 0))
    keep = order[(running <= max_tokens) | (running - n[order] < min_tokens)]
    keep.sort()
    per_chunk = np.bincount(chunk[keep], minlength=len(sentences))
    offsets = np.concatenate([[0], np.cumsum(per_chunk)])
    lists = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(number[keep], pa.int32())
    )
    rows = np.concatenate([[0], np.cumsum(sizes(chunks))])
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), lists)


def kept_in_runs(chunks: pa.Array, max_tokens: int, min_tokens: int) -> pa.Array:
    """``kept_sentences`` over runs of rows of bounded size."""

    def ends(lists: pa.Array) -> np.ndarray:
        sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.cumsum(sizes)])

    sentences = chunks.flatten()
    words = ends(sentences.flatten())[ends(sentences)[ends(chunks)]]
    parts = [
        kept_sentences(chunks.slice(first, last - first), max_tokens, min_tokens)
        for first, last in runs(np.diff(words), RANKED_WORDS)
    ]
    return pa.concat_arrays(parts) if parts else kept_sentences(chunks, max_tokens, min_tokens)


def ranking(words: Column, max_tokens: int, min_tokens: int) -> Column:
    """STRUCT(kept, elapsed): ``kept_sentences`` and each row's share of the seconds."""

    @F.arrow_udf("struct<kept:array<array<int>>,elapsed:double>")
    def rank(chunks: pa.Array) -> pa.Array:
        started = time.perf_counter()
        kept = kept_in_runs(chunks, max_tokens, min_tokens)
        each = (time.perf_counter() - started) / max(len(chunks), 1)
        release()
        return pa.StructArray.from_arrays(
            [kept, pa.array(np.full(len(chunks), each))], fields=list(PICKS)
        )

    return rank.asNondeterministic()(words)


def extractive_arrays(
    base: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    max_tokens: int = 150,
    min_tokens: int = 30,
) -> DataFrame:
    """``keys, chunks, partials, elapsed``: a summary for every chunk of every row.

    A sentence scores the mean in-chunk frequency of its words. Sentences are
    kept in order of score (ties: position) while the running word count stays
    within ``max_tokens`` or is still below ``min_tokens``, and come out in their
    original order. The input has no limit. Row by row: no shuffle, sort or join;
    ``keys`` are any columns to hand through.
    """
    texts = F.transform("chunks", lambda c: X.sentences(F.coalesce(c, F.lit(""))))
    words = F.transform("_sentences", lambda s: F.transform(s, X.word_tokens))

    def partial(sentences: Column, kept: Column) -> Column:
        chosen = F.array_join(F.transform(kept, lambda i: F.get(sentences, i)), " ")
        return X.let(chosen, lambda t: X.first_units(t, max_tokens))

    return (
        base.select(*keys, "chunks")
        .withColumn("_sentences", texts)
        .withColumn("_picks", ranking(words, max_tokens, min_tokens))
        .select(
            *keys,
            "chunks",
            F.zip_with("_sentences", "_picks.kept", partial).alias("partials"),
            F.col("_picks.elapsed").alias("elapsed"),
        )
    )


def summarize_chunks(
    chunks: DataFrame,
    keys: Sequence[str] = ("doc_id", "chunk_no"),
    chunk: str = "chunk",
    max_tokens: int = 150,
    min_tokens: int = 30,
) -> DataFrame:
    """``keys, chunk, summary, model_name, error, elapsed`` for a table of chunks."""
    base = chunks.select(*keys, F.array(chunk).alias("chunks"))
    done = extractive_arrays(base, keys, max_tokens, min_tokens)
    return done.select(
        *keys,
        F.get("chunks", F.lit(0)).alias("chunk"),
        F.get("partials", F.lit(0)).alias("summary"),
        F.lit(EXTRACTIVE).alias("model_name"),
        F.lit(None).cast("string").alias("error"),
        "elapsed",
    )


Model = Callable[[list[str]], list[str]]
RESULT = pa.struct([("summary", pa.string()), ("error", pa.string()), ("elapsed", pa.float64())])


def run_model(model: Model, texts: list[str]) -> list[tuple]:
    """``(summary, error, seconds)`` per text; a failing batch is retried text by text."""
    started = time.perf_counter()
    try:
        summaries = list(model(texts))
        if len(summaries) != len(texts):
            raise ValueError("the model must return one summary per text")
        each = (time.perf_counter() - started) / max(len(texts), 1)
        return [(s, None, each) for s in summaries]
    except Exception as exc:  # noqa: BLE001 - any model error becomes a row value
        if len(texts) == 1:
            detail = f"{P.MSG_MODEL_FAILED} {described(exc)}"
            return [(None, detail, time.perf_counter() - started)]
    return [row for t in texts for row in run_model(model, [t])]


#: The model of this process, by the call it belongs to: one at a time.
LOADED: dict[str, Model | str] = {}


def loaded(
    call: str, load: Callable[..., Model], limits: dict[str, int], seconds: float | None
) -> Model | str:
    """The model of a call, loaded once per process; its error text if that fails.

    With a time limit the model lives in a child process, which the next call ends.
    """
    if call not in LOADED:
        for old in LOADED.values():
            if isinstance(old, ModelProcess):
                old.close()
        LOADED.clear()
        try:
            LOADED[call] = load(**limits) if seconds is None else ModelProcess(load, limits, seconds)
        except Exception as exc:  # noqa: BLE001 - any error becomes a row value
            LOADED[call] = f"{P.MSG_MODEL_FAILED} {described(exc)}"
    return LOADED[call]


def accepted(load: Callable[..., Model], limits: dict[str, int]) -> dict[str, int]:
    """Those of the limits that ``load`` takes as keywords."""
    known = inspect.signature(load).parameters.values()
    if any(p.kind is p.VAR_KEYWORD for p in known):
        return limits
    return {k: v for k, v in limits.items() if k in {p.name for p in known}}


def map_summarizer(
    chunks: DataFrame,
    load: Callable[..., Model],
    model_name: str,
    keys: Sequence[str] = ("doc_id", "chunk_no"),
    chunk: str = "chunk",
    batch_size: int = 32,
    tasks: int | None = None,
    params: Params = Params(),
    carry: Sequence[str] = (),
    max_tokens: int | None = None,
    min_tokens: int | None = None,
) -> DataFrame:
    """Summaries from a user's model: ``load()`` gives ``list[str] -> list[str]``.

    The model is loaded once per worker process and sees batches of ``batch_size``
    texts, cut to ``params.model_input_tokens`` (``truncated`` tells). If ``load`` has
    parameters ``max_tokens`` and ``min_tokens``, it gets the limits of a summary.
    Errors, of loading too, become the ``error`` of their chunk; empty texts are
    refused before the model. A call of the model that takes longer than
    ``params.model_seconds`` is ended with its process; the texts of the batch are then
    tried one by one, each with that limit, so only a text that hangs fails. None sets no
    limit and keeps the model in the worker's own process. ``tasks`` scales this stage apart from the rest;
    ``carry`` names columns to hand through.
    """
    limits = {
        "max_tokens": params.max_summary_tokens if max_tokens is None else max_tokens,
        "min_tokens": params.min_summary_tokens if min_tokens is None else min_tokens,
    }
    limits, call = accepted(load, limits), uuid.uuid4().hex

    @F.arrow_udf("struct<summary:string,error:string,elapsed:double>")
    def summarize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            model = loaded(call, load, limits, params.model_seconds)
            rows: list[tuple] = [(None, P.MSG_EMPTY_REQUEST, 0.0)] * len(texts)
            given = [i for i, t in enumerate(texts) if t]
            for k in range(0, len(given), batch_size):
                part = given[k : k + batch_size]
                if isinstance(model, str):
                    done = [(None, model, 0.0)] * len(part)
                else:
                    done = run_model(model, [texts[i] for i in part])
                for i, row in zip(part, done):
                    rows[i] = row
            names = [f.name for f in RESULT]
            yield pa.array([dict(zip(names, r)) for r in rows], RESULT)

    rows = chunks.select(*keys, *carry, F.col(chunk).alias("chunk"))
    rows = rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)
    cut = X.truncate_units(F.col("chunk"), params.model_input_tokens, params.n_special)
    result = summarize.asNondeterministic()(F.col("_cut.text"))
    return rows.withColumn("_cut", cut).withColumn("_result", result).select(
        *keys,
        *carry,
        "chunk",
        "_result.summary",
        F.when(F.col("_result.error").isNull(), F.lit(model_name)).alias("model_name"),
        "_result.error",
        "_result.elapsed",
        "_cut.truncated",
    )
