"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kurzwerk.functions.batches import release
from kurzwerk.llm.common import (
    FINE_SLICE_BYTES,
    kept_tables,
    map_batches,
    ragged_take,
    slices,
    strings_between,
)

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Endings that stay with their apostrophe, as the split pattern lists them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct pieces whose merges a worker remembers; beyond it the memory starts anew.
CACHE_PIECES = 200_000
#: Code points that are classed at a time.
CLASSED_POINTS = 1 << 16


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the tokenizer library.

    A vocabulary of single bytes with a one-class pattern gives back the points of that
    class and drops all others.
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        probe = tiktoken.Encoding(
            "class", pat_str=pattern, mergeable_ranks=single, special_tokens={}
        )
        for first in range(0, len(table), CLASSED_POINTS):
            points = range(first, first + CLASSED_POINTS)
            every = "".join(chr(p) for p in points if not 0xD800 <= p < 0xE000)
            members = bytes(probe.encode_ordinary(every)).decode("utf-8")
            table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    release()
    return table


def last_true(flags: np.ndarray) -> np.ndarray:
    """For every place, the last place up to it whose flag is set (an associative scan)."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def piece_starts(points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Where the pieces of the split pattern start in code points of many rows.

    The pattern's automaton is a composition of per-point transition functions that
    depend on the point's class and on where its run of equal class began; the run
    starts are one prefix scan, the rest are shifts of the class array.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[row_starts[row_starts <= n]] = True
    fresh[n] = True
    run = fresh[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = points == 0x20
    # A blank right before a run of the other classes opens that run's piece.
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1] & ~fresh[1:n]
    start = run & ~(after_blank & ~space)
    # The last white-space point before anything else is cut off from its run.
    before_text = np.zeros(n, bool)
    before_text[:-1] = space[:-1] & ~space[1:] & ~fresh[1:n]
    start |= before_text
    # Contractions: an apostrophe that opens a piece, with one of the endings after it.
    at = np.flatnonzero((points == 0x27) & start)
    if len(at):
        run_start = last_true(run)
        row_end = np.flatnonzero(fresh)
        limit = row_end[np.searchsorted(row_end, at, "right")]
        done = np.zeros(len(at), bool)
        for ending in CONTRACTIONS:
            fits = ~done & (at + len(ending) < limit)
            for k, letter in enumerate(ending, 1):
                fits &= points[np.minimum(at + k, n - 1)] == ord(letter)
            done |= fits
            here = at[fits]
            if not len(here):
                continue
            start[here + 1] = False
            next_at = here + 1 + len(ending)
            inner = next_at < n
            next_at = next_at[inner]
            # The rest of the letters is a piece of its own; at a run's start it is one
            # already, unless a blank opens it.
            same = (run_start[next_at] == here[inner] + 1) & ~fresh[next_at]
            start[next_at[same]] = True
    return np.flatnonzero(start)


class Ranks:
    """Merge ranks of a vocabulary file with base64 pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
        top = max(self.rank.values()) + 1
        self.pieces = [b""] * top
        for piece, rank in self.rank.items():
            self.pieces[rank] = piece
        self.vocabulary = pa.array(self.pieces, pa.large_binary())
        self.memory: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the neighbours of lowest rank, leftmost first, until none has a rank."""
        whole = self.rank.get(piece)
        if whole is not None:
            return (whole,)
        rank = self.rank.get
        none = len(self.pieces)
        if len(piece) > 200:
            return self.merge_long(piece)
        cuts = list(range(len(piece) + 1))
        ranks = [rank(piece[k : k + 2], none) for k in range(len(piece) - 1)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            del cuts[k + 1]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank(piece[cuts[k] : cuts[k + 2]], none)
            if k:
                ranks[k - 1] = rank(piece[cuts[k - 1] : cuts[k + 1]], none)
        return tuple(self.rank[piece[a:b]] for a, b in zip(cuts, cuts[1:]))

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap, for pieces whose square would cost too much."""
        import heapq

        n = len(piece)
        after = list(range(1, n + 1)) + [n]
        before = list(range(-1, n))
        size = [1] * n

        def pair(k: int):
            mid = after[k]
            if mid >= n:
                return None
            r = self.rank.get(piece[k : mid + size[mid]])
            return None if r is None else (r, k, size[k], size[mid])

        heap = [p for k in range(n) if (p := pair(k))]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            mid = after[k]
            if size[k] != left or not left or mid >= n or size[mid] != right:
                continue
            size[k] += size[mid]
            size[mid] = 0
            after[k] = after[mid]
            if after[k] < n:
                before[after[k]] = k
            for j in (k, before[k]):
                if j >= 0 and (p := pair(j)):
                    heapq.heappush(heap, p)
        return tuple(self.rank[piece[k : k + size[k]]] for k in range(n) if size[k])

    def ids_of(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        memory = self.memory
        if len(memory) + len(pieces) > CACHE_PIECES:
            memory.clear()
        out = []
        for piece in pieces:
            ids = memory.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if len(piece) < 64:
                    memory[piece] = ids
            out.append(ids)
        return out

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, id offsets by row, ids of distinct pieces, their codes, piece offsets)."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        starts = piece_starts(points, np.searchsorted(place, offsets))
        cuts = np.append(place[starts], len(data))
        coded = strings_between(data, cuts).dictionary_encode()
        codes = coded.indices.to_numpy()
        distinct = self.ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        flat = np.fromiter((i for ids in distinct for i in ids), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        ids = ragged_take(flat, first[codes], sizes[codes])
        at = np.searchsorted(cuts[:-1], offsets)
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes[codes], out=ends[1:])
        return ids, ends[at], distinct, codes, at

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of rows of ids; the offsets of the pieces delimit the rows."""
        pieces = pc.take(self.vocabulary, pa.array(ids))
        return joined(pieces, offsets, b"")


def joined(values: pa.Array, offsets: np.ndarray, separator: bytes | str) -> pa.Array:
    rows = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)
    return pc.binary_join(rows, pa.scalar(separator, values.type))


#: Vocabularies of this process, by file.
LOADED: dict[str, Ranks] = kept_tables(__name__)


def ranks_of(path: str) -> Ranks:
    if path not in LOADED:
        LOADED[path] = Ranks(path)
    return LOADED[path]


def encode_texts(texts: pa.Array, path: str):
    """Per slice: (ids, id offsets, decimal ids joined by commas per row)."""
    ranks = ranks_of(path)
    for _, _, data, offsets in slices(texts, FINE_SLICE_BYTES):
        ids, at, distinct, codes, piece_at = ranks.encode_slice(data, offsets)
        words = pa.array([",".join(map(str, x)) for x in distinct], pa.large_string())
        yield ids, at, joined(pc.take(words, pa.array(codes)), piece_at, ",")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and token ids (array) of every row of ``docs`` (doc_id, text).

    ``path`` is a rank file that every worker can open. Special tokens are ordinary
    text. A null text has no ids; null ids stay; repeated rows are encoded each; other
    columns are ignored; no rows give no rows. Row-local.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = []
        for ids, at, _ in encode_texts(batch.column("text"), path):
            lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.concat_arrays(lists)], ["doc_id", "ids"]
        )

    return map_batches(plain(docs), step, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes of every row of ``tokens`` (doc_id, ids); null ids: no bytes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        content = ranks_of(path).decode(pc.list_flatten(lists).to_numpy(), offsets)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), content.cast(pa.binary())], ["doc_id", "content"]
        )

    rows = tokens.selectExpr("cast(doc_id as bigint) doc_id", "ids")
    return map_batches(rows, step, "doc_id bigint, content binary")


def plain(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: token count, digest of the ids, digest of what they decode to."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, told, back = [], [], []
        sha = lambda s: hashlib.sha256(s.as_buffer()).hexdigest()
        for ids, at, text in encode_texts(batch.column("text"), path):
            counts.append(np.diff(at))
            told += map(sha, text)
            back += map(sha, ranks_of(path).decode(ids, at))
        columns = [batch.column("doc_id"), pa.array(np.concatenate(counts)), told, back]
        columns[2:] = [pa.array(c, pa.string()) for c in columns[2:]]
        return pa.RecordBatch.from_arrays(
            columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(plain(docs), step, schema)
