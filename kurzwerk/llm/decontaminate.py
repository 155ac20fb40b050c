"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kurzwerk.llm.common import broadcast_up_to, stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits in which the fingerprints of a window and an item may differ. Two texts whose
#: shingles are 0.8 similar differ in 9.7 bits on average (standard deviation 2.9); 25
#: is more than five deviations above.
RADIUS = 25
BITS = 64
#: Bits of the counters that share one long, and the most shingles of a window that fit
#: the first; a block with a longer item takes the second.
FIELD_BITS, WIDE_FIELD_BITS = 16, 32
MOST_SHINGLES = 32_767
#: Up to so many texts' keys are broadcast; beyond, the join is a shuffle.
BROADCAST_KEYS = 100_000
#: Items compared at once; their shingles are broadcast, so this bounds what is.
BLOCK_ITEMS = 20_000
BLOCK_SHINGLES = 2_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``n_words`` and ``shingles``: a hash for every five words in a row."""
    pair = lambda a, b: F.xxhash64(a, b)
    ahead = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    df = df.withColumn("_words", words(F.col(text)))
    df = df.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    df = df.withColumn("_two", F.zip_with("_one", ahead(F.col("_one"), 1), pair))
    df = df.withColumn("_four", F.zip_with("_two", ahead(F.col("_two"), 2), pair))
    df = df.withColumn("_five", F.zip_with("_four", ahead(F.col("_one"), 4), pair))
    n = F.size("_one")
    return (
        df.withColumn("n_words", n)
        .withColumn("shingles", F.slice("_five", 1, F.greatest(n - 4, F.lit(0))))
        .drop("_one", "_two", "_four", "_five")
    )


def simhash(
    rows: DataFrame, keys: list[str], shingle: str, field_bits: int = FIELD_BITS
) -> DataFrame:
    """A 64-bit fingerprint per key: the majority of each bit over its shingle rows.

    16 longs hold the counts of four bits each, so the majorities of 64 bits are 16 sums
    (wide: 32 longs of two counts).
    """
    lanes = BITS * field_bits // 64
    mask = sum(1 << (field_bits * j) for j in range(64 // field_bits))
    sums = [
        F.sum(F.shiftrightunsigned(F.col(shingle), k).bitwiseAND(F.lit(mask))).alias(f"_s{k}")
        for k in range(lanes)
    ]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n_shingles"), *sums)
    bits = F.lit(0).cast("bigint")
    for k in range(lanes):
        for j in range(64 // field_bits):
            count = F.shiftrightunsigned(f"_s{k}", field_bits * j).bitwiseAND(F.lit((1 << field_bits) - 1))
            bit = F.when(count * 2 > F.col("n_shingles"), F.lit(1 << k).cast("bigint")).otherwise(
                F.lit(0).cast("bigint")
            )
            bits = bits.bitwiseOR(F.shiftleft(bit, field_bits * j))
    return counted.select(*keys, "n_shingles", bits.alias("fingerprint"))


def blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 pieces of a fingerprint: two within the radius agree in one of them."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    pieces = [
        F.struct(
            F.lit(k).alias("block"),
            F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"),
        )
        for k, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    return F.array(*pieces)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    row_columns: list[str] | None = None,
) -> DataFrame:
    """Benchmark items that appear in documents: one row per row of ``docs`` and item.

    Reads doc_id, text and item_id, text. Every window of an item's number of words that
    holds enough of its five-word shingles to be alike, in any order and at any place,
    gets a fingerprint; windows
    meet items of their size whose fingerprints differ in at most ``radius`` bits (all
    of them: the multi-index blocks lose none); pairs whose weighted shingle similarity
    (sum of smaller over sum of larger counts) is at least ``similarity`` are returned:
    doc_id (or ``row_columns``), item_id, similarity (best window), first_word and
    n_window_words of that window (the earliest of equals).

    Words are lower-case runs of letters and digits. Null texts are empty. Documents
    and items with fewer than five words have no shingle and match nothing. Null ids are
    kept as they are. Repeated rows of ``docs`` give rows each; items repeated with one
    item_id and text count once.
    A document shorter than an item is one window. Other columns are ignored.
    """
    spark = docs.sparkSession
    kept = row_columns or ["doc_id"]
    items = benchmark.select("item_id", "text").distinct()
    items = with_shingles(items, "text").filter("n_words >= 5").drop("text")
    items = stored(
        items.withColumn("item", F.monotonically_increasing_id()), "benchmark-items"
    )
    size = items.agg(
        F.count("*").alias("n"),
        F.max(F.size("shingles")).alias("most"),
        F.sum(F.size("shingles")).alias("total"),
    ).first()
    field_bits = WIDE_FIELD_BITS if size.n and size.most > MOST_SHINGLES else FIELD_BITS
    rows = docs.select(*kept, "text")
    n_blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-(size.total or 0) // BLOCK_SHINGLES))
    found = None
    for k in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k)
        pairs = one_block(rows, part, kept, similarity, radius, field_bits)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def window_starts(similarity: float) -> Column:
    """Starts of all windows that hold enough places of an item's shingles (``places``).

    A window and an item of the given similarity share s / (1 + s) of their shingles'
    number at least. So many neighbouring places must lie in a window; its starts reach
    from where it ends with the last of them to the first.
    """
    wide = F.col("item_words") - 4
    inside = F.least(wide, F.col("n_words") - 4)
    share = similarity / (1 + similarity)
    need = F.greatest(F.ceil(F.lit(share) * (inside + wide) - 1e-6), F.lit(1)).cast("int")
    none = F.array().cast("array<int>")

    def around(k: Column) -> Column:
        first = F.greatest(F.get("places", k + need - 1) - inside + 1, F.lit(0))
        last = F.least(F.get("places", k), F.col("n_words") - 4 - inside)
        return F.when(first <= last, F.sequence(first, last)).otherwise(none)

    spare = F.size("places") - need
    every = F.flatten(F.transform(F.sequence(F.lit(0), spare), around))
    return F.when(spare >= 0, F.array_distinct(every)).otherwise(none)


def one_block(
    docs: DataFrame,
    items: DataFrame,
    kept: list[str],
    similarity: float,
    radius: int,
    field_bits: int = FIELD_BITS,
) -> DataFrame:
    """``contaminated`` for items whose shingles are few enough to broadcast."""
    known = items.select(
        "item", F.col("n_words").alias("item_words"), F.posexplode("shingles").alias("q", "shingle")
    )
    every = F.broadcast(items.agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("known")))
    touched = with_shingles(docs, "text").drop("text").filter("n_words >= 5").crossJoin(every)
    touched = touched.filter(F.arrays_overlap("shingles", "known")).drop("known")
    touched = stored(touched.withColumn("row", F.monotonically_increasing_id()), "touched-documents")

    hits = touched.select("row", "n_words", F.posexplode("shingles").alias("p", "shingle")).join(
        F.broadcast(known.select("item", "item_words", "shingle").distinct()), "shingle"
    )
    placed = hits.groupBy("row", "n_words", "item", "item_words").agg(
        F.sort_array(F.collect_list("p")).alias("places")
    )
    windows = (
        placed.select("row", F.explode(window_starts(similarity)).alias("start"), "item_words")
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", "item_words")).alias("windows"))
        .join(touched.select("row", "shingles"), "row")
        .select("row", "shingles", F.explode("windows").alias("w"))
        .select(
            "row",
            "w.start",
            "w.item_words",
            F.slice("shingles", F.col("w.start") + 1, F.col("w.item_words") - 4).alias("inside"),
        )
    )
    windows = stored(windows, "windows")
    keys = ["row", "start", "item_words"]
    prints = simhash(windows.select(*keys, F.explode("inside").alias("shingle")), keys, "shingle", field_bits)
    item_prints = simhash(known, ["item", "item_words"], "shingle", field_bits).withColumnsRenamed(
        {"fingerprint": "item_fingerprint", "n_shingles": "item_shingles"}
    )
    indexed = item_prints.select("*", F.explode(blocks(F.col("item_fingerprint"), radius)).alias("b"))
    near = (
        prints.select("*", F.explode(blocks(F.col("fingerprint"), radius)).alias("b"))
        .join(F.broadcast(indexed), ["item_words", "b"])
        .filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius)
        .select(*keys, "item", "n_shingles", "item_shingles")
        .distinct()
    )
    counted = (
        near.join(windows, keys)
        .select(*keys, "item", "n_shingles", "item_shingles", F.explode("inside").alias("shingle"))
        .groupBy(*keys, "item", "n_shingles", "item_shingles", "shingle")
        .agg(F.count("*").alias("c"))
    )
    weights = known.groupBy("item", "shingle").agg(F.count("*").alias("item_c"))
    shared = (
        counted.join(F.broadcast(weights), ["item", "shingle"])
        .groupBy(*keys, "item", "n_shingles", "item_shingles")
        .agg(F.sum(F.least("c", "item_c")).alias("shared"))
    )
    union = F.col("n_shingles") + F.col("item_shingles") - F.col("shared")
    alike = shared.withColumn("similarity", F.col("shared") / union).filter(
        F.col("similarity") >= similarity
    )
    best = alike.groupBy("row", "item").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "start", "item_words")).alias("best")
    )
    return (
        best.join(touched.select("row", "n_words", *kept), "row")
        .join(F.broadcast(items.select("item", "item_id")), "item")
        .select(
            *kept,
            "item_id",
            (-F.col("best.s")).alias("similarity"),
            F.col("best.start").cast("bigint").alias("first_word"),
            F.least("best.item_words", "n_words").cast("bigint").alias("n_window_words"),
        )
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item appears, with all their columns.

    Rows are told apart by doc_id and text; a text is as clean as its copies.
    """
    names = docs.columns
    key = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    found = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark)
    dirty = stored(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    dirty = broadcast_up_to(dirty, BROADCAST_KEYS)
    return docs.withColumn("_key", key).join(dirty, "_key", "left_anti").select(names)
