"""Token counters for chunking: blank-separated units (JVM) or a subword vocabulary (Arrow)."""

from __future__ import annotations

import functools
import os
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kurzwerk.functions import text as X
from kurzwerk.functions.batches import release, runs

#: Bytes of text that the tokenizer library codes at a time; what it keeps of a text while
#: it does takes a hundred times the text.
CODED_BYTES = 1 << 18


class TokenCounter(Protocol):
    """What chunking needs to know about tokens."""

    def count(self, text: Column) -> Column: ...

    def counts(self, sentences: Column) -> Column: ...

    def pieces(self, sentences: Column, size: int) -> Column: ...


class Units:
    """Counts blank-separated units; needs no Python worker."""

    def count(self, text: Column) -> Column:
        return X.unit_count(text)

    def counts(self, sentences: Column) -> Column:
        return F.transform(sentences, X.unit_count)

    def pieces(self, sentences: Column, size: int) -> Column:
        """Fixed-size slices of every non-null sentence, null for the others."""

        def cut(sentence: Column) -> Column:
            return X.let(
                X.units(sentence),
                lambda u: F.transform(
                    F.sequence(F.lit(0), F.size(u) - 1, F.lit(size)),
                    lambda i: F.array_join(F.slice(u, i + 1, size), " "),
                ),
            )

        return F.transform(sentences, lambda s: F.when(s.isNotNull(), cut(s)))


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """One tokenizer per Python worker and file; files added to the job are found too."""
    # One task has one core; the library's own threads would only compete.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    return Tokenizer.from_file(path)


class Subwords:
    """Counts ids of a tokenizer file (``tokenizers`` JSON), without special tokens.

    ``path`` must exist on every executor or have been given to
    ``SparkContext.addFile``.
    """

    def __init__(self, path: str):
        self.path = path

    def sizes(self, texts: pa.Array) -> pa.Array:
        """Ids of every text of an array, in the worker; a null has none."""
        sizes = np.zeros(len(texts), np.int32)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for first, last in runs(lengths, CODED_BYTES):
            if not lengths[first:last].any():
                continue
            batch = [t or "" for t in texts.slice(first, last - first).to_pylist()]
            coded = load_tokenizer(self.path).encode_batch_fast(batch, add_special_tokens=False)
            sizes[first:last] = [len(e) for e in coded]
        return pa.array(sizes)

    def parts(self, text: str, size: int) -> list[str]:
        """The text of every ``size`` ids, in the worker."""
        tokenizer = load_tokenizer(self.path)
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return [tokenizer.decode(ids[i : i + size]) for i in range(0, len(ids), size)]

    def count(self, text: Column) -> Column:
        @F.arrow_udf("int")
        def subword_count(texts: pa.Array) -> pa.Array:
            sizes = self.sizes(texts)
            release()
            return sizes

        return subword_count.asNondeterministic()(text)

    def counts(self, sentences: Column) -> Column:
        @F.arrow_udf("array<int>")
        def subword_counts(rows: pa.Array) -> pa.Array:
            return like(rows, self.sizes(rows.flatten()))

        return subword_counts.asNondeterministic()(sentences)

    def pieces(self, sentences: Column, size: int) -> Column:
        @F.arrow_udf("array<array<string>>")
        def subword_pieces(rows: pa.Array) -> pa.Array:
            flat = [None if s is None else self.parts(s, size) for s in rows.flatten().to_pylist()]
            return like(rows, pa.array(flat, pa.list_(pa.string())))

        return subword_pieces.asNondeterministic()(sentences)


def like(rows: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` in lists as long as those of ``rows``; a null list is an empty one."""
    lengths = pc.fill_null(rows.value_lengths(), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
