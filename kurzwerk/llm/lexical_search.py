"""Ranked lexical search: short posting lists summed first, long ones skipped through."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kurzwerk.llm.common import map_batches, slices, stored
from kurzwerk.llm.terms import folded_terms

#: A segment of the index is closed at so many documents or postings.
SEGMENT_DOCS = 8_192
SEGMENT_POSTINGS = 500_000
#: Lists of at most this share of a segment's documents are summed term by term.
SHORT_SHARE = 1 / 16
#: Places of a segment that one step document by document goes through.
STRIDE = 2_048
#: Items are searched in blocks of at most so many items, or terms of items.
BLOCK_ITEMS = 20_000
BLOCK_TERMS = 2_000_000

SEGMENT = (
    "doc_ids array<bigint>, lengths array<bigint>, terms array<int>, ends array<int>,"
    " places array<int>, tfs array<bigint>"
)
HITS = "item int, doc_id bigint, score bigint, place int"


def term_array(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all terms, first term of every row and the end)."""
    folded, starts, ends, rows = folded_terms(data, offsets)
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    terms = pa.Array.from_buffers(
        pa.large_binary(),
        len(starts),
        [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(folded[folded != 0]))],
    )
    return terms, rows


# --- items --------------------------------------------------------------------


@dataclass
class Block:
    """Some items: their ids, their distinct terms as numbers into ``terms``."""

    ids: list[int | None]
    wanted: list[np.ndarray]
    terms: pa.Array


def item_blocks(items: DataFrame, most_items: int, most_terms: int) -> Iterator[Block]:
    """The rows of ``items`` dealt into blocks; one block at a time is on the driver."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = []
        for _, _, data, offsets in slices(batch.column("text")):
            terms, rows = term_array(data, offsets)
            for a, b in zip(rows, rows[1:]):
                lists.append(pc.unique(terms.slice(a, b - a)).to_pylist())
        kinds = [pa.int64(), pa.list_(pa.binary())]
        columns = [batch.column("item_id"), pa.array(lists, kinds[1])]
        return pa.RecordBatch.from_arrays(columns, ["item_id", "terms"])

    rows = items.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text")
    rows = map_batches(rows, step, "item_id bigint, terms array<binary>")
    ids, lists, held = [], [], 0
    for row in rows.toLocalIterator():
        ids.append(row.item_id)
        lists.append([bytes(t) for t in row.terms])
        held += len(lists[-1])
        if len(ids) >= most_items or held >= most_terms:
            yield numbered(ids, lists)
            ids, lists, held = [], [], 0
    if ids:
        yield numbered(ids, lists)


def numbered(ids: list, lists: list[list[bytes]]) -> Block:
    number: dict[bytes, int] = {}
    wanted = [
        np.array([number.setdefault(t, len(number)) for t in terms], np.int64) for terms in lists
    ]
    return Block(ids, wanted, pa.array(list(number), pa.large_binary()))


# --- index --------------------------------------------------------------------


class Builder:
    """Collects documents with their postings and closes them into a segment."""

    def __init__(self):
        self.ids, self.lengths, self.parts, self.docs, self.postings = [], [], [], 0, 0

    def add(self, ids: pa.Array, lengths: np.ndarray, row: np.ndarray, term, tf) -> None:
        self.parts.append((row + self.docs, term, tf))
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.docs += len(ids)
        self.postings += len(row)

    def close(self) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        order = pc.array_sort_indices(ids, order="ascending").to_numpy()  # nulls come last
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row, term, tf = (np.concatenate(x) for x in zip(*self.parts))
        place = rank[row]
        by_term = np.lexsort((place, term))
        held, sizes = np.unique(term, return_counts=True)
        lengths = np.concatenate(self.lengths)[order]
        columns = [
            (pc.take(ids, pa.array(order)), pa.int64()),
            (lengths, pa.int64()),
            (held, pa.int32()),
            (np.cumsum(sizes), pa.int32()),
            (place[by_term], pa.int32()),
            (tf[by_term], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(
            [one_list(pa.array(values, kind)) for values, kind in columns],
            [c.split()[0] for c in SEGMENT.split(", ")],
        )


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def index_batches(
    batches: Iterator[pa.RecordBatch], terms: pa.Array
) -> Iterator[pa.RecordBatch]:
    """Segments of the documents of one task."""
    builder, base = Builder(), max(len(terms), 1)
    for batch in batches:
        for first, last, data, offsets in slices(batch.column("text")):
            found, rows = term_array(data, offsets)
            number = pc.fill_null(pc.index_in(found, value_set=terms), -1).to_numpy()
            lengths = np.diff(rows)
            at = np.flatnonzero(number >= 0)
            key = np.repeat(np.arange(len(lengths)), lengths)[at] * base + number[at]
            key, tf = np.unique(key, return_counts=True)
            row, term = np.divmod(key, base)
            full = lengths > 0
            ids = batch.column("doc_id").slice(first, last - first).filter(pa.array(full))
            if len(ids):
                builder.add(ids, lengths[full], (np.cumsum(full) - 1)[row], term, tf)
            if builder.docs >= SEGMENT_DOCS or builder.postings >= SEGMENT_POSTINGS:
                yield builder.close()
                builder = Builder()
    if builder.docs:
        yield builder.close()


def index_segments(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """Segments of an inverted index of ``docs`` (doc_id, text) over ``terms``.

    A segment is one row: the documents that hold any term at all, by id, with their
    lengths, and for each of the wanted terms its posting list (places of documents,
    ascending, and occurrences); ``ends`` are the ends of the lists.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(partial(index_batches, terms=terms), SEGMENT)


@dataclass
class Statistics:
    """Documents with a term, all their terms, and the weight of each wanted term."""

    documents: int
    length: int
    weights: np.ndarray

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        """m of the documents; in Python's integers where 64 bits might not do."""
        if len(lengths) and 50 * int(lengths.max()) * self.documents >= 1 << 63:
            every = [50 + 50 * int(n) * self.documents // self.length for n in lengths]
            return np.array(every, np.int64)
        return 50 + 50 * lengths * self.documents // self.length


def count_batches(
    batches: Iterator[pa.RecordBatch], n_terms: int
) -> Iterator[pa.RecordBatch]:
    """(term, documents) of the segments of one task; -1 counts documents, -2 their terms."""
    df = np.zeros(n_terms, np.int64)
    documents = length = 0
    for batch in batches:
        for k in range(batch.num_rows):
            lengths, terms, ends = (
                batch.column(c)[k].values.to_numpy() for c in ("lengths", "terms", "ends")
            )
            documents += len(lengths)
            length += int(lengths.sum())
            df[terms] += np.diff(ends, prepend=0)
    held = np.flatnonzero(df)
    term = np.concatenate([[-1, -2], held])
    count = np.concatenate([[documents, length], df[held]])
    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(count)], ["term", "n"])


def statistics(counts: dict[int, int], n_terms: int) -> Statistics:
    documents, length = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(n_terms, np.int64)
    df[list(counts)] = list(counts.values())
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    return Statistics(documents, length, weights)


def statistics_of(segments: DataFrame, n_terms: int) -> Statistics:
    """Counts over all documents: each task sums its segments, Spark sums the tasks.

    The driver gets one row per term of the block.
    """
    rows = segments.select("lengths", "terms", "ends")
    rows = rows.mapInArrow(partial(count_batches, n_terms=n_terms), "term bigint, n bigint")
    rows = rows.groupBy("term").agg(F.sum("n").alias("n")).collect()
    return statistics({r.term: r.n for r in rows}, n_terms)


# --- search -------------------------------------------------------------------


class Best:
    """The k best documents of one item so far: by score, then by id, nulls last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """A document below this score cannot be among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score = np.concatenate([self.score, score])
        doc, null = np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Segment:
    """Posting lists of a segment with the scores that each posting adds."""

    def __init__(self, batch: pa.RecordBatch, k: int, of: Statistics):
        column = lambda name: batch.column(name)[k].values
        ids = column("doc_ids")
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, 0).to_numpy()
        self.terms, self.ends = column("terms").to_numpy(), column("ends").to_numpy()
        self.places, tf = column("places").to_numpy(), column("tfs").to_numpy()
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.sizes = self.ends - self.starts
        m = of.damping(column("lengths").to_numpy())
        weight = np.repeat(of.weights[self.terms], self.sizes)
        self.gain = weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.places]))
        self.most = (
            np.maximum.reduceat(self.gain, self.starts) if len(self.starts) else self.gain[:0]
        )

    def lists_of(self, wanted: np.ndarray) -> np.ndarray:
        """Numbers of the lists of those wanted terms that occur here."""
        at = np.searchsorted(self.terms, wanted)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == wanted[here]
        return at[here]

    def postings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        cut = slice(self.starts[k], self.ends[k])
        return self.places[cut], self.gain[cut]


def search_segment(segment: Segment, wanted: np.ndarray, best: Best) -> None:
    """Put the documents of a segment that belong to an item's best into ``best``.

    Short lists are summed term by term into accumulators; these are then one more
    iterator, bounded by their largest sum, beside the long lists. Iterators whose
    bounds together stay below the floor name no candidates: they are only looked into
    for candidates of the others that can still reach it.
    """
    lists = segment.lists_of(wanted)
    if not len(lists):
        return
    n = len(segment.ids)
    short = segment.sizes[lists] <= max(1, int(n * SHORT_SHARE))
    total = np.zeros(n, np.int64)
    for k in lists[short]:
        places, gain = segment.postings(k)
        total[places] += gain
    summed = np.flatnonzero(total)
    floor = best.floor
    iterators = [(int(segment.most[k]), *segment.postings(k)) for k in lists[~short]]
    if len(summed):
        sums = total[summed]
        iterators.append((int(sums.max()), summed, sums))
        if len(sums) >= best.k:
            # Whole scores are no smaller than these sums.
            floor = max(floor, int(np.partition(sums, -best.k)[-best.k]))
    iterators.sort(key=lambda x: x[0])
    bounds = np.cumsum([x[0] for x in iterators])
    for low in range(0, n, STRIDE):
        if bounds[-1] < floor:
            return
        first = int(np.searchsorted(bounds, floor))
        high = min(low + STRIDE, n)
        window = np.zeros(high - low, np.int64)
        for _, places, gain in iterators[first:]:
            a, b = np.searchsorted(places, (low, high))
            window[places[a:b] - low] += gain[a:b]
        at = np.flatnonzero(window)
        score = window[at]
        for k in range(first - 1, -1, -1):
            fit = score + bounds[k] >= floor
            at, score = at[fit], score[fit]
            if not len(at):
                break
            _, places, gain = iterators[k]
            found = np.searchsorted(places, at + low)
            here = found < len(places)
            here[here] = places[found[here]] == at[here] + low
            score = score.copy()
            score[here] += gain[found[here]]
        fit = score >= floor
        if fit.any():
            at = at[fit] + low
            best.add(score[fit], segment.ids[at], segment.null[at])
            floor = max(floor, best.floor)


def search_batches(
    batches: Iterator[pa.RecordBatch], block: Block, of: Statistics, k: int
) -> Iterator[pa.RecordBatch]:
    """The k best documents of every item among the segments of one task."""
    best = [Best(k) for _ in block.wanted]
    for batch in batches:
        for row in range(batch.num_rows):
            segment = Segment(batch, row, of)
            for wanted, held in zip(block.wanted, best):
                search_segment(segment, wanted, held)
    for item, held in enumerate(best):
        if n := len(held.score):
            columns = [
                pa.array(np.full(n, item), pa.int32()),
                pa.array(held.doc, pa.int64(), mask=held.null),
                pa.array(held.score, pa.int64()),
                pa.array(np.arange(1, n + 1), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in HITS.split(", ")])


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    block_items: int = BLOCK_ITEMS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The k documents of ``docs`` (doc_id, text) that score highest for each row of ``items``.

    Gives item_id, rank, doc_id and score; only scores above 0, equal ones by ascending
    doc_id. The items (item_id, text) are the queries: they are dealt into blocks, and
    an index of all documents over the terms of a block is written once, in segments.
    Document frequencies and lengths are counted over all documents. Each task keeps
    the best of its segments; of these, only those at or above the largest k-th score
    of any task are ranked.

    Null texts have no terms and neither match nor count. Documents without id rank
    behind equal scores with one; items without id are items. Repeated documents count
    and rank each; repeated items give their rows each. Other columns are ignored; no
    documents or no items give no rows.
    """
    found = []
    for block in item_blocks(items, block_items, block_terms):
        if not len(block.terms):
            continue
        segments = stored(index_segments(docs, block.terms), "search-index")
        of = statistics_of(segments, len(block.terms))
        hits = segments.mapInArrow(partial(search_batches, block=block, of=of, k=k), HITS)
        hits = stored(hits, "search-hits")
        floors = hits.filter(F.col("place") == k).groupBy("item").agg(F.max("score").alias("floor"))
        names = [(n, item_id) for n, item_id in enumerate(block.ids)]
        names = docs.sparkSession.createDataFrame(names, "item int, item_id bigint")
        order = Window.partitionBy("item").orderBy(
            F.col("score").desc(), F.col("doc_id").asc_nulls_last()
        )
        found.append(
            hits.join(floors, "item", "left")
            .filter("floor is null or score >= floor")
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .join(names, "item")
            .select("item_id", "rank", "doc_id", "score")
        )
    if not found:
        schema = "item_id bigint, rank int, doc_id bigint, score bigint"
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found)
