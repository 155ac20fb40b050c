"""Near-duplicate classes by dart-throwing weighted MinHash and banded joining."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kurzwerk.llm.common import (
    FINE_SLICE_BYTES,
    Rolling,
    broadcast_up_to,
    fit_for_broadcast,
    free_up_to,
    is_word_byte,
    likely,
    map_batches,
    mix,
    slices,
    stored,
)

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 28 bands of 5 coordinates: a pair of similarity 0.8 shares none with odds of 1.5e-5.
BANDS, ROWS = 28, 5
#: Up to so many rows (some 150 bytes each in the driver) are broadcast; beyond, the join
#: is a shuffle.
BROADCAST_KEYS = 100_000
#: Buckets up to this size have all pairs of different components compared. In larger
#: ones the members outside of the largest component meet ``PIVOTS`` texts of it and
#: one of the others per round; an exact join then compares what is still apart.
SMALL_BUCKET = 50
PIVOTS = 8
PIVOT_ROUNDS = 2
#: Ratio of neighbouring size classes of the exact join.
SIZE_STEP = 1.02
#: Cells (a power of two) of the sketch of counts that ranks shingles in the exact join.
RARITY_BITS = 16
#: Cells that are added up together.
COUNT_BLOCK = 1 << 13
#: Bits per shingle of the map that tells which of them texts of several components hold,
#: its largest size (a power of two, 16 MiB) and the bits that are counted together.
MARKS_PER_UNIT = 16
MOST_MARKS = 27
BLOCK_BITS = 17
#: Holders of a shingle from which the exact join deals them into several parts.
HOT_UNIT = 1000
#: Share of equal coordinates below which a pair is not verified: 4.6 standard deviations
#: under that of a pair of similarity 0.8.
LEAST_EQUAL = 0.64
#: Ranks below 2 ** -FIRST_BAND are one cell of the dart board, those above are doubled.
FIRST_BAND = 12


class Darts:
    """Signatures of weighted sets.

    Every unit of weight of every element is a strip of a board that is unbounded along
    the rank axis. The strip is cut into cells, and each cell holds a Poisson number of
    darts at hashed places, the same wherever the element occurs. A set throws the darts
    of its strips up to a rank at which about k ln k + 2k are expected; each falls into
    one of k coordinates, which keeps the earliest. Sets with a coordinate left empty
    throw again up to twice the rank.
    """

    def __init__(self, k: int):
        self.k = k
        self.expected = k * math.log(max(k, 2)) + 2 * k
        self.tables: dict[float, np.ndarray] = {}

    def poisson(self, mean: float, uniform: np.ndarray) -> np.ndarray:
        table = self.tables.get(mean)
        if table is None:
            top = int(mean + 12 * math.sqrt(mean) + 24)
            logs = [n * math.log(mean) - mean - math.lgamma(n + 1) for n in range(top)]
            table = self.tables[mean] = np.cumsum(np.exp(logs))
        return np.searchsorted(table, uniform, "right")

    @staticmethod
    def uniform(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53

    def throw(self, units: np.ndarray, row: np.ndarray, limit: np.ndarray, best: np.ndarray):
        """Keep the lowest rank per row and coordinate in ``best`` (row-major, k per row)."""
        low, high, band = 0.0, 2.0**-FIRST_BAND, 0
        top = float(limit.max()) if len(limit) else 0.0
        while low < top:
            alive = np.flatnonzero(limit[row] > low)
            cell = mix(units[alive] + np.uint64((0x9E3779B97F4A7C15 * (band + 1)) % (1 << 64)))
            count = self.poisson(high - low, self.uniform(cell))
            hit = np.flatnonzero(count)
            count = count[hit]
            total = int(count.sum())
            if total:
                ends = np.cumsum(count)
                number = np.arange(total) - np.repeat(ends - count, count)
                dart = mix(
                    np.repeat(cell[hit], count)
                    + (number + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
                )
                at_row = np.repeat(row[alive[hit]], count)
                rank = low + (high - low) * self.uniform(dart)
                thrown = rank < limit[at_row]
                place = mix(dart[thrown]) % np.uint64(self.k)
                slot = at_row[thrown] * self.k + place.astype(np.int64)
                np.minimum.at(best, slot, rank[thrown])
            low, high, band = high, 2 * high, band + 1

    def signatures(self, units: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Earliest ranks, one row of k per set; rows of empty sets are infinite."""
        rows = len(offsets) - 1
        size = np.diff(offsets)
        row = np.repeat(np.arange(rows), size)
        best = np.full(rows * self.k, np.inf)
        limit = np.where(size > 0, self.expected / np.maximum(size, 1), 0.0)
        self.throw(units, row, limit, best)
        for _ in range(200):
            short = np.isinf(best.reshape(rows, self.k)).any(axis=1) & (size > 0)
            if not short.any():
                break
            limit = np.where(short, limit * 2, 0.0)
            some = short[row]
            self.throw(units[some], row[some], limit, best)
        return best.reshape(rows, self.k)


class Shingler:
    """Unit-weight elements of texts: (shingle, number of its occurrence) as hashes."""

    def __init__(self):
        self.bytes = Rolling(21)
        self.words = Rolling(22)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(data), len(offsets) - 1
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        word = np.concatenate([[False], is_word_byte(data), [False]])
        starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
        ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        at = np.searchsorted(starts, offsets)
        hashes = self.bytes.between(self.bytes.prefix(data), starts, ends)
        sums = self.words.prefix(hashes)
        n_words = np.diff(at)
        # Texts of one to four words are one shingle.
        count = np.where(n_words > 0, np.maximum(n_words - SHINGLE_WORDS + 1, 1), 0)
        out_at = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(rows), count)
        first = at[:-1][row] + np.arange(out_at[-1]) - out_at[:-1][row]
        last = np.minimum(first + SHINGLE_WORDS, at[1:][row])
        shingle = self.words.between(sums, first, last)
        keyed = shingle ^ mix(np.arange(1, rows + 1, dtype=np.uint64))[row]
        order = np.argsort(keyed, kind="stable")
        ranked = keyed[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        place = np.arange(len(ranked))
        occurrence = np.empty(len(ranked), np.uint64)
        occurrence[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
        return mix(shingle + occurrence * np.uint64(0x9E3779B97F4A7C15)), out_at


#: Tools of this process.
SHINGLER = Shingler()
DARTS: dict[int, Darts] = {}


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; sets without elements have none that others share."""
    bits = mix(signature.view(np.uint64)).reshape(len(signature), bands, rows)
    keys = np.full(bits.shape[:2], 0, np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(0xD1B54A32D192ED03) + bits[:, :, k])
    return keys


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """digest, band keys and a sketch (8 bits per coordinate) of every row with words."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        darts = DARTS.setdefault(bands * rows, Darts(bands * rows))
        keys, held, marks = [], [], []
        for _, _, data, offsets in slices(batch.column("text"), FINE_SLICE_BYTES):
            units, at = SHINGLER.units(data, offsets)
            some = np.diff(at) > 0
            held.append(some)
            signature = darts.signatures(units, at)[some]
            signature = np.ascontiguousarray(signature)
            keys.append(band_keys(signature, bands, rows))
            marks.append(mix(signature.view(np.uint64)).astype(np.uint8).view(np.int8))
        flat = np.concatenate(keys).view(np.int64).reshape(-1)
        digests = batch.column("digest").filter(pa.array(np.concatenate(held)))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), bands).cast(pa.list_(pa.int64()))
        flat = np.concatenate(marks).reshape(-1)
        sketch = pa.FixedSizeListArray.from_arrays(pa.array(flat), bands * rows)
        sketch = sketch.cast(pa.list_(pa.int8()))
        return pa.RecordBatch.from_arrays([digests, lists, sketch], ["digest", "keys", "sketch"])

    schema = "digest binary, keys array<bigint>, sketch array<tinyint>"
    return map_batches(docs.select("digest", "text"), step, schema)


def unit_sets(texts: DataFrame) -> DataFrame:
    """digest and unit elements of every row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = []
        for _, _, data, offsets in slices(batch.column("text"), FINE_SLICE_BYTES):
            units, at = SHINGLER.units(data, offsets)
            lists.append(
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(units.view(np.int64)))
            )
        return pa.RecordBatch.from_arrays(
            [batch.column("digest"), pa.concat_arrays(lists)], ["digest", "units"]
        )

    return map_batches(texts.select("digest", "text"), step, "digest binary, units array<bigint>")


def only(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is among the (stored) keys."""
    if fit_for_broadcast(keys, BROADCAST_KEYS):
        return rows.join(F.broadcast(keys), on, "left_semi")
    return likely(keys, on)(rows, on).join(keys.hint("merge"), on, "left_semi")


def verified(
    pairs: DataFrame, sketches: DataFrame, units: DataFrame, similarity: float, purpose: str
) -> DataFrame:
    """The pairs (a, b) whose exact weighted similarity is high enough, as a table.

    Sketches sort out what is far from it; only texts of the other pairs travel.
    """
    side = lambda t, value, c: t.select(F.col("digest").alias(c), F.col(value).alias(f"{value}_{c}"))
    near = pairs.join(side(sketches, "sketch", "a"), "a").join(side(sketches, "sketch", "b"), "b")
    equal = F.aggregate(
        F.zip_with("sketch_a", "sketch_b", lambda x, y: F.when(x == y, 1).otherwise(0)),
        F.lit(0),
        lambda total, x: total + x,
    )
    least = LEAST_EQUAL - (SIMILARITY - similarity)
    near = near.filter(equal >= F.size("sketch_a") * least).select("a", "b")
    near = stored(near, f"pairs-{purpose}")
    needed = near.select(F.col("a").alias("digest")).union(near.select("b")).distinct()
    needed = only(units, stored(needed, f"texts-{purpose}"), "digest")
    both = free_up_to(near, BROADCAST_KEYS).join(side(needed, "units", "a"), "a").join(side(needed, "units", "b"), "b")
    shared = F.size(F.array_intersect("units_a", "units_b"))
    union = F.size("units_a") + F.size("units_b") - shared
    links = both.filter(shared >= F.lit(similarity) * union).select("a", "b")
    return stored(links, f"links-{purpose}")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links lead to, for nodes with links.

    Labels spread to neighbours and then jump to the label of their label; every round
    is a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    both = stored(both, "links")
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("label")),
        "labels",
    )
    while True:
        known = broadcast_up_to(labels, BROADCAST_KEYS)
        heard = (
            both.join(known, both.b == known.node).groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        spread = heard.join(known, "node").select(
            "node", "label", F.least("label", "heard").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        jump = broadcast_up_to(jump, BROADCAST_KEYS)
        step = stored(
            spread.join(jump, "next", "left").select(
                "node", F.least("next", F.coalesce("jumped", "next")).alias("label"),
                (F.least("next", F.coalesce("jumped", "next")) != F.col("label")).alias("moved"),
            ),
            "labels",
        )
        labels = step.select("node", "label")
        if step.filter("moved").limit(1).count() == 0:
            return labels


def with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    labels = broadcast_up_to(labels, BROADCAST_KEYS)
    joined = members.join(labels, members.digest == labels.node, "left")
    return joined.select("key", "digest", F.coalesce("label", "digest").alias("label"))


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their labels, of the buckets that still hold several components."""
    labelled = with_labels(members, labels)
    several = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
    several = several.filter("x <> y").select("key", "n")
    return stored(labelled.join(several, "key"), "open-buckets")


def ordered(pairs: DataFrame) -> DataFrame:
    a, b = F.col("digest"), F.col("other")
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def small_pairs(still: DataFrame) -> DataFrame:
    """All pairs of different components, in buckets of bounded size."""
    other = still.select("key", F.col("digest").alias("other"), F.col("label").alias("other_label"))
    pairs = still.join(other, "key").filter("digest < other and label <> other_label")
    return pairs.select("digest", "other")


def pivot_pairs(large: DataFrame, number: int) -> DataFrame:
    """Members outside of a bucket's largest component with pivots, a bounded number each.

    The pivots are those of lowest hash, with the same hash in every bucket, so that a
    text meets few of them over all its buckets.
    """
    turn = [F.xxhash64(F.lit(number * PIVOTS + k), "digest") for k in range(PIVOTS)]
    lowest = [F.min(F.struct(h.alias("h"), "digest", "label")).alias(f"p{k}") for k, h in enumerate(turn)]
    parts = large.groupBy("key", "label").agg(F.count("*").alias("c"), *lowest)
    size = F.struct("c", "label")
    most = parts.groupBy("key").agg(F.max(F.struct(size.alias("s"), *[f"p{k}" for k in range(PIVOTS)])).alias("m"))
    most = most.select("key", F.col("m.s.label").alias("most"), *[f"m.p{k}" for k in range(PIVOTS)])
    rest = large.join(most, "key").filter("label <> most")
    inner = rest.groupBy("key").agg(lowest[0].alias("one"))
    pivots = F.array(*[f"p{k}" for k in range(PIVOTS)], "one")
    text = F.transform(pivots, lambda p: F.struct(p["digest"].alias("digest"), p["label"].alias("label")))
    # A text has the same pivots in many buckets; each leaves its row once.
    met = rest.join(inner, "key").groupBy("digest", "label").agg(F.flatten(F.collect_set(text)).alias("met"))
    apart = F.filter(F.array_distinct("met"), lambda p: p["label"] != F.col("label"))
    return met.select("digest", F.explode(apart).alias("p")).select("digest", F.col("p.digest").alias("other"))


def cells_of(units: np.ndarray) -> np.ndarray:
    """The cell of the count sketch that a unit falls into."""
    return (mix(units.view(np.uint64)) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def unit_counts(sets: DataFrame) -> np.ndarray:
    """How many units of all sets fall into each cell of a sketch of fixed size.

    Counted over batches in tasks, added up by Spark; only the sketch reaches the driver.
    """

    cells = 1 << RARITY_BITS

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Per block of cells: those that units of the batch fall into, and how many."""
        counts = np.bincount(cells_of(batch.column("units").flatten().to_numpy()), minlength=cells)
        cell = np.flatnonzero(counts)
        number = cell // COUNT_BLOCK
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        at = pa.array(np.append(cuts, len(cell)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (cell % COUNT_BLOCK, counts[cell])]
        return pa.RecordBatch.from_arrays([pa.array(number[cuts]), *lists], ["block", "cell", "n"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNT_BLOCK, np.int64)
        for batch in table.to_batches():
            np.add.at(total, batch.column("cell").flatten().to_numpy(), batch.column("n").flatten().to_numpy())
        return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([total.tolist()])})

    found = map_batches(sets.select("units"), step, "block bigint, cell array<bigint>, n array<bigint>")
    found = found.groupBy("block").applyInArrow(added, "block bigint, n array<bigint>").collect()
    counts = np.zeros((cells // COUNT_BLOCK, COUNT_BLOCK), np.int64)
    for r in found:
        counts[r.block] = r.n
    return counts.reshape(-1)


def rarest(batch: pa.RecordBatch, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """(row, place, unit) of the units that a pair of ``similarity`` cannot do without.

    Of n units these are the first n - s * n + 1 in one order for all sets (by the count
    of their cell, then by value); any such order is exact, a rarer one joins less.
    """
    units = batch.column("units")
    flat = units.flatten().to_numpy()
    sizes = units.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, counts[cells_of(flat)], row))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    needed = sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1
    kept = place < needed[row]
    return row[kept], place[kept], flat[order][kept]


def in_runs(batch: pa.RecordBatch, step) -> pa.RecordBatch:
    """``step`` over runs of rows of bounded numbers of units."""
    ends = np.cumsum(batch.column("units").value_lengths().to_numpy())
    cuts = [0, *(np.flatnonzero(np.diff(ends // FINE_SLICE_BYTES)) + 1).tolist(), batch.num_rows]
    return pa.concat_batches([step(batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])


def mark_of(units: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a unit in a map of 2 ** ``bits``."""
    return (mix(units.view(np.uint64) + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)


def mixed_marks(sets: DataFrame, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """(map, number of its bits as a power of two): what units of different labels fall on.

    Only the units that ``rarest`` gives are looked at. A bit is set if two labels meet on
    it, so no unit with holders of two labels is missed. The map grows with the units up to
    2 ** MOST_MARKS bits; a full one sorts out less.
    """
    total = (1 - similarity) * int(counts.sum())
    bits = min(max(math.ceil(math.log2(MARKS_PER_UNIT * total + 1)), BLOCK_BITS), MOST_MARKS)
    block = 1 << BLOCK_BITS

    def extremes(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Per block: its bits in this run, with the least and largest label on them."""
        row, _, unit = rarest(batch, counts, similarity)
        labels = np.frombuffer(b"".join(x[:8] for x in batch.column("label").to_pylist()), np.int64)
        mark, label = mark_of(unit, bits), labels[row]
        order = np.lexsort((label, mark))
        mark, label = mark[order], label[order]
        first = np.flatnonzero(np.diff(mark, prepend=-1))
        last = np.append(first[1:], len(mark))[: len(first)] - 1
        mark, least, most = mark[first], label[first], label[last]
        number = mark >> BLOCK_BITS
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        at = pa.array(np.append(cuts, len(mark)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (mark % block, least, most)]
        return pa.RecordBatch.from_arrays([pa.array(number[cuts]), *lists], ["block", "mark", "least", "most"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return in_runs(batch, extremes)

    def met(table: pa.Table) -> pa.Table:
        least, most = np.full(block, np.iinfo(np.int64).max), np.full(block, np.iinfo(np.int64).min)
        for batch in table.to_batches():
            mark = batch.column("mark").flatten().to_numpy()
            np.minimum.at(least, mark, batch.column("least").flatten().to_numpy())
            np.maximum.at(most, mark, batch.column("most").flatten().to_numpy())
        return pa.table({"block": table.column("block").slice(0, 1), "bits": [np.packbits(least < most).tobytes()]})

    schema = "block bigint, mark array<bigint>, least array<bigint>, most array<bigint>"
    found = map_batches(sets.select("label", "units"), step, schema)
    found = found.groupBy("block").applyInArrow(met, "block bigint, bits binary").collect()
    marks = np.zeros((max(1 << bits >> BLOCK_BITS, 1), block >> 3), np.uint8)
    for r in found:
        marks[r.block] = np.frombuffer(r.bits, np.uint8)
    return marks.reshape(-1), bits


def rare_prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """The units of every set that a pair of ``similarity`` cannot do without, rarest first.

    Units that only sets of one label hold (most of the rare ones) join nothing and are
    left out where they stand, but for those that share a bit with another label's.
    """
    counts = unit_counts(sets)
    marks, bits = mixed_marks(sets, counts, similarity)

    def first_units(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, place, unit = rarest(batch, counts, similarity)
        mark = mark_of(unit, bits)
        shared = (marks[mark >> 3] << (mark & 7).astype(np.uint8)) & 128 > 0
        row, place, unit = row[shared], place[shared], unit[shared]
        sizes = batch.column("units").value_lengths().to_numpy()
        columns = [batch.column(c).take(pa.array(row)) for c in ("digest", "label", "rest")]
        columns += [pa.array(sizes[row], pa.int64()), pa.array(place, pa.int64()), pa.array(unit)]
        return pa.RecordBatch.from_arrays(columns, ["digest", "label", "rest", "n", "place", "unit"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return in_runs(batch, first_units)

    schema = "digest binary, label binary, rest boolean, n bigint, place bigint, unit bigint"
    return map_batches(sets.select("digest", "label", "rest", "units"), step, schema)


def exact_pairs(large: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """All pairs of different components that can be ``similarity`` alike, in large buckets.

    Sets of n and m units that alike share at least o = s / (1 + s) * (n + m), so their
    n - o + 1 and m - o + 1 rarest units have one in common. Only these leave the sets'
    rows. Size classes hold m within narrow bounds, which keeps units that all texts of a
    family share out of the join. A pair has a member outside of its bucket's largest
    component, and only these ask.
    """
    share = similarity / (1 + similarity)
    parts = large.groupBy("key", "label").agg(F.count("*").alias("c"))
    most = parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m")).select("key", F.col("m.label").alias("most"))
    roles = large.join(most, "key").groupBy("digest", "label").agg(F.max(F.col("label") != F.col("most")).alias("rest"))
    sets = stored(units.join(roles, "digest"), "exact-sets")
    flat = stored(rare_prefixes(sets, similarity), "exact-units")
    mixed = flat.groupBy("unit").agg(
        F.count("*").alias("holders"), F.min("label").alias("x"), F.max("label").alias("y")
    )
    mixed = stored(mixed.filter("x <> y").select("unit", "holders"), "exact-mixed")
    mixed = broadcast_up_to(mixed, BROADCAST_KEYS)
    n = F.col("n")
    least = lambda m: F.ceil(F.lit(share) * (n + m) - 1e-6)
    level = F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")
    reach = math.ceil(-math.log(similarity) / math.log(SIZE_STEP)) + 1
    placed = flat.join(mixed, "unit").withColumn("level", level)
    # The smallest size of a class, with room for rounding at its edge.
    lowest = lambda c: F.floor(F.pow(F.lit(SIZE_STEP), c) * (1 - 1e-9))
    partner = F.filter(
        F.sequence(F.col("level") - reach, F.col("level") + reach),
        lambda c: F.col("place") <= n - least(F.greatest(lowest(c), F.floor(n * similarity))),
    )
    held = placed.select(
        "digest", "label", "rest", "n", "level", "place", "unit",
        F.ceil(F.col("holders") / HOT_UNIT).cast("int").alias("parts"),
    )
    held = stored(held, "exact-prefixes")
    # Only the asking side is dealt over size classes; the other stands in its own, and
    # the condition of the join looks at its place.
    asking = held.filter("rest").withColumn("part", F.pmod(F.xxhash64("digest"), "parts").cast("int"))
    asking = asking.withColumn("other_level", F.explode(partner))
    asked = held.select(
        F.col("digest").alias("other"), F.col("label").alias("b_label"), F.col("rest").alias("b_rest"),
        F.col("n").alias("b_n"), F.col("place").alias("b_place"), "unit",
        F.col("level").alias("other_level"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    # What is left from the first shared unit on must do for both.
    left = F.least(n - F.col("place"), F.col("b_n") - F.col("b_place"))
    fits = (F.col("label") != F.col("b_label")) & (left >= least(F.col("b_n")))
    fits &= ~F.col("b_rest") | (F.col("digest") < F.col("other"))
    met = free_up_to(asking, BROADCAST_KEYS).join(asked, ["unit", "other_level", "part"])
    return met.filter(fits).select("digest", "other")


def near_classes(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """The near-duplicate class of every row of ``docs`` (doc_id, text): doc_id, class_id, digest.

    Texts are weighted sets of five-word shingles (weights are their counts; words are
    runs without white space; a text of one to four words is one shingle). Texts at
    least ``similarity`` alike by weighted Jaccard are linked, equal texts always are; a
    class is what links connect, its id the smallest doc_id in it. Candidates share one
    of ``bands`` bands of ``rows`` signature coordinates and are verified exactly. Equal
    texts are handled once. In a bucket, texts meet one pivot first; then only texts of
    different components meet, all of them in small buckets, a bounded number of pivots
    in larger ones, where an exact join finds the links that are left.

    Null texts are empty; empty texts are one class. Null ids take part and have no say
    in class_id. Repeated rows give a row each. Other columns are ignored; no rows give
    no rows.
    """
    rows_in = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows_in = rows_in.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    first = F.first(F.struct("keys", "sketch")).alias("s")
    banded = sketches(rows_in, bands, rows).groupBy("digest").agg(first).select("digest", "s.*")
    banded = stored(banded, "sketches")
    exploded = banded.select("digest", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("pivot"))
    members = stored(exploded.join(shared.filter("n > 1"), "key"), "buckets")
    texts = stored(members.select("digest").distinct(), "bucket-texts")
    units = unit_sets(only(rows_in, texts, "digest")).groupBy("digest")
    units = stored(units.agg(F.first("units").alias("units")), "units")
    marks = stored(only(banded.select("digest", "sketch"), texts, "digest"), "bucket-sketches")

    # The pivot that most bands give.
    votes = members.filter("digest <> pivot").groupBy("digest", "pivot").agg(F.count("*").alias("v"))
    voted = votes.groupBy("digest").agg(F.min(F.struct((-F.col("v")).alias("v"), "pivot")).alias("p"))
    pairs = ordered(voted.select("digest", F.col("p.pivot").alias("other")))
    links = verified(pairs, marks, units, similarity, "0")
    labels = components(links)
    members = members.select("key", "digest")
    for number in range(1, PIVOT_ROUNDS + 1):
        still = open_buckets(members, labels)
        large = free_up_to(still.filter(F.col("n") > SMALL_BUCKET), BROADCAST_KEYS)
        pairs = pivot_pairs(large, number)
        if number == 1:
            small = free_up_to(still.filter(F.col("n") <= SMALL_BUCKET), BROADCAST_KEYS)
            pairs = pairs.union(small_pairs(small))
        new = verified(ordered(pairs), marks, units, similarity, str(number))
        members = large.select("key", "digest")
        if new.limit(1).count() == 0:
            break
        links = links.union(new)
        labels = components(links)
    large = free_up_to(open_buckets(members, labels), BROADCAST_KEYS)
    if large.limit(1).count():
        pairs = ordered(exact_pairs(large, units, similarity))
        new = verified(pairs, marks, units, similarity, "exact")
        if new.limit(1).count():
            labels = components(links.union(new))

    ids = rows_in.select("doc_id", "digest")
    labels = free_up_to(labels.withColumnRenamed("node", "digest"), BROADCAST_KEYS)
    roots = ids.join(labels, "digest", "left").select(
        "doc_id", "digest", F.coalesce("label", "digest").alias("root")
    )
    classes = roots.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return roots.join(classes, "root").select("doc_id", "class_id", "digest")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every class: that of smallest doc_id, with all columns.

    Rows of one doc_id in one class: the smallest text digest; equal rows: one of them.
    A class without any doc_id keeps its row of smallest digest.
    """
    names = docs.columns
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    found = stored(near_classes(docs), "near-classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    # Classes of rows without ids are told apart by digest.
    chosen = (
        found.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("digest")).alias("d"))
        .agg(F.min(order).alias("o"))
        .select(F.xxhash64("o.doc_id", "o.digest").alias("_h"), F.col("o.doc_id").alias("_id"), F.col("o.digest").alias("_digest"))
    )
    # The rows of a class that go are fewer than those that stay.
    pairs = found.select("doc_id", "digest").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    gone = pairs.join(chosen.hint("merge"), (F.xxhash64("doc_id", "digest") == F.col("_h")) & same, "left_anti")
    gone = gone.select(F.xxhash64("doc_id", "digest").alias("_h"), F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    gone = stored(gone, "gone")
    rows = docs.withColumn("_digest2", digest)
    key = F.xxhash64(rows["doc_id"].cast("bigint"), rows["_digest2"])

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        same = rows["doc_id"].cast("bigint").eqNullSafe(gone["_id"]) & (rows["_digest2"] == gone["_digest"])
        return rows.join(gone, (key == gone["_h"]) & same, "left_anti")

    if fit_for_broadcast(gone, BROADCAST_KEYS):
        kept = without(rows, F.broadcast(gone))
    else:
        # Rows that cannot be among them stay where they are.
        chosen = likely(gone, "_h")
        kept = without(chosen(rows, key), gone.hint("merge")).union(chosen(rows, key, held=False))
    repeated = found.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count()
    if repeated:
        kept = kept.dropDuplicates(["doc_id", "_digest2"])
    return kept.select(names)
