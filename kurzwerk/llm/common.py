"""Helpers shared by the operators: reading, Arrow text buffers, hashing, files."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kurzwerk.functions.batches import release
from kurzwerk.session import remove_work, ship_package, work_dir

#: Bytes of text that one vectorised step handles; a longer text is one step of its own.
SLICE_BYTES = 2 << 20
#: The same for steps that hold many numbers for every byte.
FINE_SLICE_BYTES = 1 << 19
#: Bits per key of the map that ``likely`` looks into, as powers of two, and its largest
#: size (16 MiB); beyond that more rows pass.
KEY_BITS, MOST_KEY_BITS = 4, 27


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage."""
    place = work_dir(df.sparkSession, purpose)
    df.write.parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    out.stored_at = place
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for table in tables:
        remove_work(table.sparkSession, table.stored_at)


def map_batches(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """Row-local step over Arrow batches; a task leaves no freed memory in its process."""
    owner = getattr(step, "__module__", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work_of(owner)
        for batch in batches:
            if batch.num_rows:
                yield step(batch)
        release()

    return df.mapInArrow(run, schema)


#: Tables that operators keep from task to task in a process, and whose turn it was last.
TABLES: dict[str, dict] = {}
LAST: list[str] = []


def kept_tables(owner: str) -> dict:
    """A dictionary for an operator's tables, emptied when another one's tasks begin.

    Processes are used again by the stages that follow; without this each would hold the
    vocabularies and memories of all stages before.
    """
    return TABLES.setdefault(owner, {})


def work_of(owner: str) -> None:
    if LAST and LAST[0] != owner:
        for name, tables in TABLES.items():
            if name != owner:
                tables.clear()
        release()
    LAST[:] = [owner]


def slices(
    texts: pa.Array, size: int | None = None
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, next row, bytes, row offsets) of runs of rows of bounded size.

    A null is an empty text.
    """
    size = size or SLICE_BYTES
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    large = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    n = len(large)
    offsets = np.frombuffer(large.buffers()[1], np.int64, n + 1, large.offset * 8)
    data = large.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield (
            first,
            last,
            data[offsets[first] : offsets[last]],
            offsets[first : last + 1] - offsets[first],
        )
        first = last


def strings_between(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The byte strings between neighbouring cuts, without a copy of the data."""
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(cuts) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(data)],
    )


def ragged_take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[k] : starts[k] + sizes[k]] for every k, one after another."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    shift = np.repeat(starts - (ends - sizes), sizes)
    return flat[np.arange(total) + shift]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; equal stays equal."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Powers of the two bases and of their inverses, shared by all hashes of a process.
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Odd 64-bit numbers; two hashes of one sequence take different ones.
BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**k, base**-k) modulo 2**64 for k below n or more; as long as ever asked for."""
    one = np.ones(1, np.uint64)
    held = POWERS.get(base, (one, one))
    if len(held[0]) < n:
        inverse = pow(base, -1, 1 << 64)
        grown = []
        for table, factor in zip(held, (base, inverse)):
            out = np.empty(n, np.uint64)
            k = len(table)
            out[:k] = table
            while k < n:
                more = min(k, n - k)
                out[k : k + more] = out[:more] * np.uint64(pow(factor, k, 1 << 64))
                k += more
            grown.append(out)
        POWERS[base] = held = tuple(grown)
    return held


class Rolling:
    """Hashes of any stretch of a sequence from prefix sums, modulo 2**64.

    Seeds that differ by an odd number give independent hashes of one sequence.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = BASES[seed % 2]
        self.table = rng.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return powers(self.base, n)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of a byte or uint64 sequence, for ``between``."""
        up, _ = self._powers(len(values) + 1)
        values = self.table[values] if values.dtype == np.uint8 else values
        out = np.empty(len(values) + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * down[start])


def filesystem(place: str):
    """(file system, path) of a location that Python tasks read and write."""
    from pyarrow import fs

    if "://" not in place and not place.startswith("file:"):
        return fs.LocalFileSystem(), place
    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(place)


def is_word_byte(data: np.ndarray) -> np.ndarray:
    """Bytes outside of space and 0x09-0x0D."""
    return (data != 32) & ((data < 9) | (data > 13))


def fit_for_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most ``rows`` rows (counted, not estimated)."""
    return df.limit(rows + 1).count() <= rows


def free_up_to(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that Spark may broadcast only if it has at most ``rows`` rows.

    Spark judges by compressed files, which repeated keys make a hundredth of what is
    broadcast.
    """
    return df if fit_for_broadcast(df, rows) else df.hint("merge")


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join: broadcast if it has at most ``rows`` rows, else never."""
    return F.broadcast(df) if fit_for_broadcast(df, rows) else df.hint("merge")


def likely(keys: DataFrame, on: str) -> Callable[..., DataFrame]:
    """A filter of rows by a column: keeps those of all (stored) keys and few others.

    With ``held=False`` it keeps the rest instead, rows that no key can have. Those need
    not travel to the exact join. Only a map of bits of bounded size is broadcast.
    """
    bits = min(max(math.ceil(math.log2(keys.count() + 1)) + KEY_BITS, 6), MOST_KEY_BITS)

    def place(column: str | Column) -> tuple[Column, Column]:
        mark = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
        return F.shiftrightunsigned(mark, 6).cast("int"), mark.bitwiseAND(F.lit(63)).cast("int")

    word, bit = place(on)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    found = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word")
    found = found.agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
    table = keys.sparkSession.createDataFrame(pa.table({"words": words}))

    def chosen(rows: DataFrame, column: str | Column, held: bool = True) -> DataFrame:
        name = "words" + "_" * max(map(len, rows.columns))
        word, bit = place(column)
        found = F.call_function("shiftrightunsigned", F.get(name, word), bit).bitwiseAND(F.lit(1))
        rows = rows.crossJoin(F.broadcast(table.withColumnRenamed("words", name)))
        return rows.filter(found == int(held)).drop(name)

    return chosen
