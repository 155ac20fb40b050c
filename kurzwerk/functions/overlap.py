"""Shared n-grams and longest common subsequence of two token lists, pair by pair.

One Arrow step: the tokens of a run of pairs are coded by a dictionary once, both sides
alike, and everything after that works on the codes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kurzwerk.functions.batches import release, runs
from kurzwerk.functions.lcs import lcs_length
from kurzwerk.functions.stem import stem

#: Tokens of both sides that are handled at a time; a longer pair is one step of its own.
RUN_TOKENS = 1 << 17


def coded(lists: Sequence[pa.Array], stemmed: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, row offsets) of columns of token lists under one dictionary; null is empty."""
    flat = [rows.flatten().cast(pa.string()) for rows in lists]
    codes = pa.concat_arrays(flat).dictionary_encode()
    number = codes.indices.to_numpy(zero_copy_only=False)
    if stemmed:
        stems = pa.array([stem(w) for w in codes.dictionary.to_pylist()], pa.string())
        number = stems.dictionary_encode().indices.to_numpy(zero_copy_only=False)[number]
    out, at = [], 0
    for rows, tokens in zip(lists, flat):
        sizes = pc.fill_null(rows.value_lengths(), 0).to_numpy(zero_copy_only=False)
        out.append((number[at : at + len(tokens)], np.concatenate([[0], np.cumsum(sizes)])))
        at += len(tokens)
    return out


def gram_codes(
    sides: list[tuple[np.ndarray, np.ndarray]], n: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(gram, row) of all n-grams of both sides; equal grams have equal numbers.

    A gram is numbered as the pair of a shorter gram and its last token; the numbers are
    made dense again after each step, so that they stay small for any n.
    """
    tokens = [codes.astype(np.int64) for codes, _ in sides]
    base = max((int(t.max()) + 1 for t in tokens if len(t)), default=1)
    grams = [(t, np.arange(len(t))) for t in tokens]
    for k in range(1, n):
        grams = [(g[p + k < len(t)], p[p + k < len(t)]) for (g, p), t in zip(grams, tokens)]
        grams = [(g * base + t[p + k], p) for (g, p), t in zip(grams, tokens)]
        _, dense = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
        split = len(grams[0][0])
        grams = [(dense[:split], grams[0][1]), (dense[split:], grams[1][1])]
    out = []
    for (gram, place), (_, offsets) in zip(grams, sides):
        row = np.searchsorted(offsets, place, "right") - 1
        inside = place + n <= offsets[row + 1]
        out.append((gram[inside], row[inside]))
    return out


def shared_grams(sides: list[tuple[np.ndarray, np.ndarray]], n: int, rows: int) -> np.ndarray:
    """Per row, how many n-grams the two sides share, repetitions counted as often as both have."""
    grams = gram_codes(sides, n)
    base = max((int(g.max()) + 1 for g, _ in grams if len(g)), default=1)
    (a, a_count), (b, b_count) = (
        np.unique(row * base + gram, return_counts=True) for gram, row in grams
    )
    both, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = np.zeros(rows, np.int64)
    np.add.at(total, both // base, np.minimum(a_count[in_a], b_count[in_b]))
    return total


def run_columns(
    reference: pa.Array, candidate: pa.Array, orders: Sequence[int], longest: bool, stemmed: bool
) -> list[np.ndarray]:
    """The counts of ``overlap_counts`` for pairs that are held at a time, by column."""
    sides = coded([reference, candidate], stemmed)
    columns = [np.diff(offsets) for _, offsets in sides]
    columns += [shared_grams(sides, n, len(reference)) for n in orders]
    if longest:
        (a, a_at), (b, b_at) = [(codes.tolist(), offsets.tolist()) for codes, offsets in sides]
        columns.append(np.array([
            lcs_length(a[i:j], b[k:m]) for i, j, k, m in zip(a_at, a_at[1:], b_at, b_at[1:])
        ], np.int64))
    return columns


def count_columns(reference: pa.Array, candidate: pa.Array, *how) -> list[np.ndarray]:
    """``run_columns`` over runs of pairs of bounded size."""
    sizes = sum(
        pc.fill_null(rows.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for rows in (reference, candidate)
    )
    parts = [
        run_columns(reference.slice(a, b - a), candidate.slice(a, b - a), *how)
        for a, b in runs(sizes, RUN_TOKENS)
    ]
    return [np.concatenate(c) for c in zip(*parts)] if parts else run_columns(reference, candidate, *how)


def overlap_counts(
    reference: Column, candidate: Column, orders: Sequence[int], longest: bool, stemmed: bool
) -> Column:
    """Struct of counts of two ARRAY<STRING> columns.

    ``n_reference``, ``n_candidate``: their sizes; ``shared_<n>`` per order; with
    ``longest``, ``lcs``. A null list is an empty one.
    """
    names = ["n_reference", "n_candidate", *[f"shared_{n}" for n in orders]]
    names += ["lcs"] if longest else []

    @F.arrow_udf(f"struct<{','.join(f'{name}:bigint' for name in names)}>")
    def counts(reference: pa.Array, candidate: pa.Array) -> pa.Array:
        columns = count_columns(reference, candidate, orders, longest, stemmed)
        release()
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return counts(reference, candidate)
