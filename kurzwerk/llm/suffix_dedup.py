"""Removal of byte strings that occur more than once, by names of sampled windows.

This replaces the difference-cover suffix array, whose sampled triples alone are several
bytes of shuffle per byte of text; nothing here is ranked or sorted as suffixes. Windows
are the strings of ``length`` bytes.

1. Every window chooses a place in it by its content alone (that of its smallest hashed
   64-byte string), so that equal windows choose the same place; neighbouring windows
   mostly share theirs, which makes one sample per 170 bytes.
2. A sample with the text under all windows that chose it is named by a hash of 128 bits.
   Names that occur twice are repeated texts; samples whose 64-byte string is unique are
   not repeated.
3. Of the rest, the windows of a sample are parted by their distance from it, in steps of
   64 bytes, then 8, then singly, and named and counted again; a window of 400 bytes is
   repeated if its name and distance occur twice.

Names are hashes of 128 bits; inner strings, which only prune, have 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kurzwerk.llm.common import (
    FINE_SLICE_BYTES,
    Rolling,
    dropped,
    likely,
    map_batches,
    mix,
    slices,
    stored,
)

LENGTH = 400
SAMPLE_BYTES = 64
STEPS = (64, 8, 1)
PLACE_BITS = 24
#: Windows handled at once; a longer text is cut into overlapping pieces. Every byte
#: takes some 150 while it is sampled.
PIECE_BYTES = FINE_SLICE_BYTES
#: Up to so many samples or spans are broadcast (some 70 bytes each in the driver) to the
#: scan of the texts.
BROADCAST_ENTRIES = 500_000

NAMES = Rolling(31), Rolling(32)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    n = len(values)
    if n < width:
        return values[:0]
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    back = np.minimum.accumulate(grid, axis=1).reshape(-1)
    return np.minimum(ahead[: n - width + 1], back[width - 1 : n])


def salted(key: np.ndarray, step: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    salt = (np.uint64(step) << np.uint64(40)) + (low.astype(np.uint64) << np.uint64(20))
    return mix(key + mix(salt + high.astype(np.uint64) + np.uint64(1)))


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first row, base place, bytes, offsets): slices, long texts as overlapping pieces."""
    if len(offsets) > 2 or len(data) <= PIECE_BYTES + length:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - length + 1, PIECE_BYTES):
        part = data[at : at + PIECE_BYTES + length - 1]
        yield at, part, np.array([0, len(part)])


def samples_of(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row, place in the row, least and most distance of its windows, string, names)."""
    n = len(data)
    if n < length:
        empty = np.zeros(0, np.int64)
        return (empty, empty, empty, empty, *(np.zeros(0, np.uint64) for _ in range(3)))
    prefix = [r.prefix(data) for r in NAMES]
    _, down = NAMES[0]._powers(n + 1)
    k = SAMPLE_BYTES
    strings = mix((prefix[0][k:] - prefix[0][:-k]) * down[: n - k + 1])
    mask = np.uint64((1 << PLACE_BITS) - 1)
    ranked = (strings & ~mask) | np.arange(len(strings), dtype=np.uint64)
    chosen = (sliding_min(ranked, length - k + 1) & mask).astype(np.int64)
    start = np.arange(len(chosen))
    row = np.searchsorted(offsets, start, "right") - 1
    valid = start + length <= offsets[row + 1]
    start, row, place = start[valid], row[valid], chosen[valid]
    if not len(start):
        return samples_of(data[:0], offsets[:1], length)
    change = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(np.concatenate([[True], change]))
    last = np.append(first[1:], len(start)) - 1
    place, row = place[first], row[first]
    low, high = place - start[last], place - start[first]
    names = [
        salted(r.between(p, start[first], start[last] + length), 0, low, high)
        for r, p in zip(NAMES, prefix)
    ]
    return row, place - offsets[row], low, high, strings[place], *names


SAMPLE_SCHEMA = (
    "digest binary, place bigint, low int, high int, weight int, inner bigint, u1 bigint,"
    " u2 bigint"
)
NAMES_OF_COLUMNS = [c.split()[0] for c in SAMPLE_SCHEMA.split(",")]


def sample_batch(digests: pa.Array, texts: pa.Array, length: int) -> pa.RecordBatch:
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    for first, _, data, offsets in slices(texts, FINE_SLICE_BYTES):
        for base, part, at in pieces(data, offsets, length):
            found = list(samples_of(part, at, length))
            found[0] = found[0] + first
            found[1] = found[1] + base
            for held, new in zip(columns, found):
                held.append(new)
    row, place, low, high, *names = (np.concatenate(c) for c in columns)
    arrays = [pc.take(digests, pa.array(row)), pa.array(place)]
    arrays += [pa.array(c.astype(np.int32)) for c in (low, high, np.ones(len(row)))]
    arrays += [pa.array(c.view(np.int64)) for c in names]
    return pa.RecordBatch.from_arrays(arrays, NAMES_OF_COLUMNS)


def finer_batch(batch: pa.RecordBatch, step: int, length: int) -> pa.RecordBatch:
    """The nodes of every text in ``batch`` cut into steps, with their names."""
    out: list[list[np.ndarray]] = [[] for _ in range(8)]
    nodes = batch.column("nodes")
    texts = batch.column("text")
    for r in range(batch.num_rows):
        held = nodes[r].values
        place = held.field("place").to_numpy()
        low = held.field("low").to_numpy().astype(np.int64)
        high = held.field("high").to_numpy().astype(np.int64)
        # Only the stretches under the nodes are hashed; nodes are taken in order of place.
        data = np.frombuffer(texts[r].as_buffer(), np.uint8)
        count = high // step - low // step + 1
        node = np.repeat(np.arange(len(place)), count)
        ends = np.cumsum(count)
        block = (low // step)[node] + np.arange(ends[-1]) - (ends - count)[node]
        first = np.maximum(low[node], block * step)
        last = np.minimum(high[node], block * step + step - 1)
        p = place[node]
        begin, end = p - last, p - first + length
        inner_begin, inner_end = p - block * step, p - (block * step + step - 1) + length
        keys = np.zeros((3, len(p)), np.uint64)
        for at in range(0, len(p), 1 << 16):
            part = slice(at, at + (1 << 16))
            origin, stop = int(begin[part].min()), int(end[part].max())
            window = data[origin:stop]
            prefix = [x.prefix(window) for x in NAMES]
            for k in range(2):
                name = NAMES[k].between(prefix[k], begin[part] - origin, end[part] - origin)
                keys[k, part] = salted(name, step, first[part], last[part])
            name = NAMES[0].between(prefix[0], inner_begin[part] - origin, inner_end[part] - origin)
            keys[2, part] = salted(name, step + 512, block[part], block[part])
        weight = held.field("weight").to_numpy()[node]
        columns = [np.full(len(p), r), p, first, last, weight, keys[2], keys[0], keys[1]]
        for have, new in zip(out, columns):
            have.append(new)
    row, place, low, high, weight, *names = (np.concatenate(c) for c in out)
    arrays = [pc.take(batch.column("digest"), pa.array(row)), pa.array(place)]
    arrays += [pa.array(c.astype(np.int32)) for c in (low, high, weight)]
    arrays += [pa.array(c.view(np.int64)) for c in names]
    return pa.RecordBatch.from_arrays(arrays, NAMES_OF_COLUMNS)


def joined_to_texts(
    texts: DataFrame, lists: DataFrame, entries: int, how: str, digest: str = "digest"
) -> DataFrame:
    """Texts with the list of their digest; small lists are broadcast, large ones shuffled.

    Texts that cannot have a list do not travel.
    """
    if entries <= BROADCAST_ENTRIES:
        return texts.join(F.broadcast(lists), digest, how)
    chosen = likely(lists, digest)
    joined = chosen(texts, digest).join(lists.hint("merge"), digest, how)
    if how == "inner":
        return joined
    return joined.unionByName(chosen(texts, digest, held=False), allowMissingColumns=True)


def settle(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated nodes, nodes to be cut finer) of a stored level.

    A node is repeated if its whole name weighs two or more. Nodes go on where an inner
    string has a node that is not repeated and weighs two or more: those nodes, and of
    the repeated ones one for each name, with the weight of two.
    """
    place = F.struct("digest", "place")
    name = nodes.groupBy("u1", "u2").agg(F.sum("weight").alias("n"), F.min(place).alias("first"))
    told = nodes.join(name.filter("n > 1"), ["u1", "u2"], "left")
    told = stored(
        told.select(
            "digest",
            "place",
            "low",
            "high",
            "weight",
            "inner",
            F.col("n").isNotNull().alias("done"),
            (F.col("n").isNull() | (place == F.col("first"))).alias("stays"),
        ),
        "settled",
    )
    stays = told.filter("stays").withColumn("weight", F.when(F.col("done"), 2).otherwise(1))
    on = stays.groupBy("inner").agg(F.sum("weight").alias("n"), F.min("done").alias("all_done"))
    on = on.filter("n > 1 and not all_done").select("inner")
    return told.filter("done and weight = 1"), stays.join(on, "inner", "left_semi")


def keyed(docs: DataFrame, digest: str = "digest") -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumn(digest, F.unhex(F.md5(text.cast("binary"))))


def unused(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per text that holds repeated windows: digest and spans (start, end of bytes).

    ``docs`` has text; digest is the binary md5 of a text. A span is the text under a run
    of neighbouring windows (``length`` bytes each) that also start anywhere else, in the
    same or another row of ``docs``. Spans may touch and overlap.
    """
    if not SAMPLE_BYTES < length <= 1 << 19:
        raise ValueError(f"length must be over {SAMPLE_BYTES} and at most {1 << 19}")
    texts = keyed(docs.select("text")).select("digest", "text")
    long_enough = texts.filter(F.octet_length("text") >= length)

    def first_level(batch: pa.RecordBatch) -> pa.RecordBatch:
        return sample_batch(batch.column("digest"), batch.column("text"), length)

    samples = stored(map_batches(long_enough, first_level, SAMPLE_SCHEMA), "samples")
    again = samples.groupBy("inner").count().filter("count > 1").select("inner")
    nodes = stored(samples.join(again, "inner", "left_semi").select(samples.columns), "level")
    dropped(samples)
    found = []
    for step in (*STEPS, None):
        done, rest = settle(nodes)
        found.append(done)
        dropped(nodes)
        if step is None:
            break
        node = F.struct("place", "low", "high", "weight")
        lists = rest.groupBy("digest").agg(F.sort_array(F.collect_set(node)).alias("nodes"))
        lists = stored(lists, "nodes")
        entries = lists.agg(F.sum(F.size("nodes"))).first()[0] or 0
        if not entries:
            break

        def finer(batch: pa.RecordBatch, step: int = step) -> pa.RecordBatch:
            return finer_batch(batch, step, length)

        joined = joined_to_texts(long_enough, lists, entries, "inner")
        nodes = stored(map_batches(joined, finer, SAMPLE_SCHEMA), f"level-{step}")
        dropped(lists)
    spans = None
    for part in found:
        part = part.select(
            "digest",
            F.struct((F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end")).alias("span"),
        )
        spans = part if spans is None else spans.union(part)
    return spans.groupBy("digest").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans, in order of their starts, with those that touch or overlap made one."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:], len(starts)) - 1
    return starts[fresh], reach[last]


def cut(text: bytes, spans: pa.StructArray | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    if spans is None or not len(spans):
        return text, 0, 0
    starts, ends = merged(spans.field("start").to_numpy(), spans.field("end").to_numpy())
    kept, at = [], 0
    for a, b in zip(starts, ends):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), int((ends - starts).sum()), len(starts)


def with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """``docs`` with the spans of every text, and the name of their column."""
    spans = stored(repeated_spans(docs, length), "spans")
    entries = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    digest, name = unused(docs, "digest"), unused(docs, "spans")
    spans = spans.withColumnsRenamed({"digest": digest, "spans": name})
    return joined_to_texts(keyed(docs, digest), spans, entries, "left", digest), name


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Figures of the removal for every row of ``docs`` (doc_id, text).

    Texts are bytes in UTF-8; null texts are empty. Each byte under a string of
    ``length`` bytes that also starts elsewhere (same text included, overlaps count) is
    removed; all is judged on the input. Returns doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256. Null ids stay; repeated rows repeat each other's
    strings and so lose them; texts below ``length`` bytes stay whole; other columns are
    ignored; no rows give no rows.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        spans = batch.column("spans")
        for r, text in enumerate(batch.column("text")):
            data = text.as_buffer().to_pybytes()
            kept, n, runs = cut(data, spans[r].values)
            rows.append((len(data), n, runs, hashlib.sha256(kept).hexdigest()))
        columns = [pa.array(c) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found, _ = with_spans(rows, length)
    return map_batches(found.select("doc_id", "text", "spans"), step, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of text, and without texts left empty.

    Bytes of characters that a cut has split go too; n_chars, where there is such a
    column, is counted anew. All other columns stay, whatever their names; null and empty
    texts go, repeated rows lose the strings they share, no rows give no rows.
    """
    names = docs.columns
    found, held = with_spans(docs, length)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        # Only texts that lose something become Python objects.
        spans, texts = batch.column(held), batch.column("text")
        cuts: list[bytes | None] = [None] * batch.num_rows
        for r in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
            kept, _, _ = cut(texts[r].as_buffer().to_pybytes(), spans[r].values)
            cuts[r] = kept.decode("utf-8", "ignore").encode()
        left = pc.coalesce(pa.array(cuts, pa.binary()).cast(texts.type), texts)
        columns = [left if c == "text" else batch.column(c) for c in names]
        if "n_chars" in names:
            kind = batch.schema.field("n_chars").type
            columns[names.index("n_chars")] = pc.utf8_length(left).cast(kind)
        out = pa.RecordBatch.from_arrays(columns, names)
        return out.filter(pc.greater(pc.binary_length(left), 0))

    return map_batches(found.select(*names, held), step, docs.schema)
