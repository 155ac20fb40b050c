"""Quality rules: characters inside repeated n-grams and lines, by rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kurzwerk.llm.common import FINE_SLICE_BYTES, Rolling, is_word_byte, map_batches, mix, slices

#: Largest share of a text's word characters that may lie in n-grams of n words
#: found twice or more. Fixed values of published pre-training filters.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Likewise for characters of lines that equal an earlier line, and for the lines.
LINE_CHARS_LIMIT = 0.20
LINES_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
    " n_repeat_words bigint, base_failed boolean, kept boolean,"
    " dup_line_share double, dup_ngram_shares array<double>"
)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key: does it occur twice or more; is it an earlier key's repetition."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    later = np.zeros(len(keys), bool)
    twice = np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


class Kernel:
    """Figures of all texts of a slice at once."""

    def __init__(self, ngrams: dict[int, float]):
        self.ngrams = ngrams
        self.bytes = Rolling(11)
        self.words = Rolling(12)
        self.symbol = np.zeros(256, bool)
        self.symbol[list(SYMBOLS)] = True

    def per_row(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    def figures(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        n, rows = len(data), len(offsets) - 1
        row_salt = mix(np.arange(1, rows + 1, dtype=np.uint64))
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        word = is_word_byte(data)
        before = np.zeros(n + 1, bool)
        before[1:] = word
        after = np.zeros(n + 1, bool)
        after[:n] = word
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        lead = (data & 0xC0) != 0x80
        chars = np.zeros(n + 1, np.int64)
        np.cumsum(lead & word, out=chars[1:])
        word_at = np.searchsorted(starts, offsets)
        out = {
            "n_words": np.diff(word_at),
            "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
            "n_symbols": self.per_row(self.symbol[data], offsets),
        }
        prefix = self.bytes.prefix(data)
        size = chars[ends] - chars[starts]
        of_row = np.repeat(np.arange(rows), out["n_words"])
        sums = self.words.prefix(self.bytes.between(prefix, starts, ends))
        last_word = word_at[1:][of_row]
        shares = []
        for k in sorted({8, *self.ngrams}):
            at = np.arange(max(0, len(starts) - k + 1))
            at = at[at + k <= last_word[: len(at)]]
            keys = self.words.between(sums, at, at + k) ^ row_salt[of_row[at]]
            twice, _ = repeats(keys)
            step = np.zeros(len(starts) + 1, np.int64)
            step[at[twice]] += 1
            step[at[twice] + k] -= 1
            covered = np.cumsum(step[:-1]) > 0
            if k == 8:
                out["n_repeat_words"] = self.per_row(covered, word_at)
            if k in self.ngrams:
                shares.append(self.per_row(np.where(covered, size, 0), word_at))
        out["ngram_chars"] = np.array(shares).reshape(len(shares), rows)

        newline = data == 10
        cut = np.zeros(n + 1, bool)
        cut[1:] = newline
        line_starts = np.flatnonzero((cut | edge)[:n])
        breaks = np.append(np.flatnonzero(newline), n)
        line_ends = np.minimum(
            breaks[np.searchsorted(breaks, line_starts)],
            offsets[np.searchsorted(offsets, line_starts, "right")],
        )
        line_chars = chars[line_ends] - chars[line_starts]
        held = line_chars > 0
        line_starts, line_ends, line_chars = line_starts[held], line_ends[held], line_chars[held]
        line_at = np.searchsorted(line_starts, offsets)
        line_row = np.repeat(np.arange(rows), np.diff(line_at))
        keys = self.bytes.between(prefix, line_starts, line_ends) ^ row_salt[line_row]
        _, later = repeats(keys)
        out["n_lines"] = np.diff(line_at)
        out["n_dup_lines"] = self.per_row(later, line_at)
        out["dup_line_chars"] = self.per_row(np.where(later, line_chars, 0), line_at)
        return out


def figures_of(texts: pa.Array, limits: dict[int, float], lines: tuple[float, float], least: int):
    """Figures and verdicts of an Arrow column of texts."""
    kernel = KERNELS.setdefault(tuple(sorted(limits)), Kernel(limits))
    parts = [kernel.figures(d, o) for _, _, d, o in slices(texts, FINE_SLICE_BYTES)]
    f = {k: np.concatenate([p[k] for p in parts], axis=-1) for k in parts[0]}
    words, chars = f["n_words"], np.maximum(f["word_chars"], 1)
    f["base_failed"] = (words < least) | (100 * f["n_repeat_words"] > 30 * words)
    f["dup_ngram_shares"] = f["ngram_chars"] / chars
    f["dup_line_share"] = f["dup_line_chars"] / chars
    bad = (f["dup_line_share"] > lines[0]) | (f["n_dup_lines"] > lines[1] * f["n_lines"])
    for share, k in zip(f["dup_ngram_shares"], sorted(limits)):
        bad |= share > limits[k]
    f["kept"] = ~f["base_failed"] & ~bad
    return f


#: One kernel per process and set of n-gram lengths.
KERNELS: dict[tuple[int, ...], Kernel] = {}


def quality_rules(
    docs: DataFrame,
    ngrams: dict[int, float] | None = None,
    line_chars_limit: float = LINE_CHARS_LIMIT,
    lines_limit: float = LINES_LIMIT,
    min_words: int = 20,
) -> DataFrame:
    """Repetition figures and verdict of every row of ``docs`` (doc_id, text).

    A text fails the base rules below ``min_words`` words or when more than 30 % of its
    words lie in repeated 8-word windows. Of the rest, it is kept unless too many of
    its word characters lie in repeated n-grams (``ngrams``: n -> largest share) or in
    lines that equal an earlier one, or too many of its lines do.

    Null texts count as empty and fail. Null ids stay null. Repeated rows are judged
    each; other columns are ignored; no rows give no rows. Row-local: no shuffle.
    Words, lines and n-grams are compared by 64-bit hashes within one text.
    """
    limits = dict(NGRAM_LIMITS if ngrams is None else ngrams)
    lines = (line_chars_limit, lines_limit)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = figures_of(batch.column("text"), limits, lines, min_words)
        columns = [batch.column("doc_id")]
        columns += [pa.array(f[k].astype(np.int64)) for k in counts]
        columns += [pa.array(f[k]) for k in ("base_failed", "kept", "dup_line_share")]
        columns.append(pa.array(list(f["dup_ngram_shares"].T), pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(",")])

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), step, SCHEMA)


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the default rules keep, with all their columns."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = (LINE_CHARS_LIMIT, LINES_LIMIT)
        f = figures_of(batch.column(text), NGRAM_LIMITS, lines, 20)
        return batch.filter(pa.array(f["kept"]))

    return map_batches(docs, step, docs.schema)
