"""Brown class-based bigram model: exchange clustering, transitions and emissions.

Items are what gets a class: the most frequent training words, the end of a text, and
types (by the last bytes) of all other words. The probability of a text is the product of
P(class | class before) * P(item | class) over its words and its end, times
P(word | type) for words within a type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kurzwerk.llm.common import is_word_byte, map_batches, slices, stored, strings_between

END = ""
CRC_DIVISOR, CRC_HELD_OUT = 7, 2


@dataclass(frozen=True)
class Settings:
    """Sizes of the model; they bound what is broadcast and held, never the counts."""

    #: Training words that are items of their own, and types of all other words.
    item_words: int = 6000
    types: int = 2048
    classes: int = 48
    #: Passes of the exchange over all items, each after a pass over the corpus.
    sweeps: int = 3
    #: So many of the most frequent words, at most, have their counts sent to every task;
    #: the others' are joined.
    near_words: int = 300_000
    #: Taken off every count within a type, for its unseen words.
    discount: float = 0.5
    transition_floor: float = 0.5
    emission_floor: float = 0.1


def token_slice(data: np.ndarray, offsets: np.ndarray):
    """(distinct words as binary, code of every word, first word of every row)."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = np.concatenate([[False], is_word_byte(data), [False]])
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[::2], cuts[1::2] = starts, ends
    # Words and the gaps between them take turns.
    parts = strings_between(data, cuts) if len(cuts) else pa.array([], pa.large_binary())
    coded = parts.take(pa.array(np.arange(0, len(parts), 2))).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, offsets)


def type_of(word: bytes, types: int) -> int:
    """The type of a word: a hash of its last three bytes."""
    h = 0
    for b in word[-3:]:
        h = (h * 257 + b + 1) % 1_000_003
    return h % types


def types_of(words: pa.Array, types: int) -> np.ndarray:
    """``type_of`` for all of an array of binary words."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset)
    ends, sizes = offsets[1:], np.diff(offsets)
    h = np.zeros(len(words), np.int64)
    if data is None or not data.size:
        return h
    data = np.frombuffer(data, np.uint8)
    for back in (3, 2, 1):
        byte = data[np.maximum(ends - back, 0)].astype(np.int64)
        h = np.where(sizes >= back, (h * 257 + byte + 1) % 1_000_003, h)
    return h % types


def held_out(doc_id) -> "F.Column":
    """Rows whose doc_id, as text, has a remainder of 2; a null id is an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % CRC_DIVISOR == CRC_HELD_OUT


def word_counts(training: DataFrame) -> DataFrame:
    """word (lower-case, as bytes) and count over all rows; the end of a text is a word."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[bytes, int] = {END.encode(): batch.num_rows}
        for _, _, data, offsets in slices(batch.column("text")):
            words, codes, _ = token_slice(data, offsets)
            counts = np.bincount(codes, minlength=len(words)).tolist()
            for word, n in zip(words.to_pylist(), counts):
                total[word] = total.get(word, 0) + n
        columns = [pa.array(list(total), pa.binary()), pa.array(total.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    each = map_batches(training.select("text"), step, "word binary, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks need to turn texts into items: bounded by the settings.

    The end is item 0, the most frequent words follow by rank, types come last.
    """

    settings: Settings
    total: int
    distinct: int
    ends: int
    #: Rank of the near words, from the most frequent one; and their counts.
    rank: dict[bytes, int] = field(default_factory=dict)
    count: np.ndarray | None = None
    type_tokens: np.ndarray | None = None
    type_words: np.ndarray | None = None

    @property
    def n_items(self) -> int:
        return 1 + self.settings.item_words + self.settings.types

    @property
    def n_own(self) -> int:
        """How many words are items of their own."""
        return min(self.settings.item_words, len(self.rank))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of every word, -1 beyond the near ones."""
        rank = self.rank
        return np.fromiter((rank.get(w, -1) for w in words), np.int64, len(words))

    def base(self, count):
        return np.log10((count + 1.0) / (self.total + self.distinct + 1.0))

    def within_type(self, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | type); all unseen words of a type are one event."""
        tokens, words = self.type_tokens[kinds], self.type_words[kinds]
        d = self.settings.discount
        mass = np.where(counts > 0, counts - d, np.maximum(d * words, d))
        return np.where(tokens > 0, np.log10(mass / np.maximum(tokens, 1)), 0.0)


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Words and counts from the lowest count that at most ``most`` words reach.

    The count is found from a histogram of some hundred steps, so nothing is sorted.
    """
    step = F.floor(F.log2("n") * 8).alias("step")
    sizes = counts.groupBy(step).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    total, least = 0, None
    for r in sorted(sizes.collect(), key=lambda r: -r.step):
        total += r.words
        if total > most:
            break
        least = r.least
    if least is None:
        return {}
    table = counts.filter(F.col("n") >= least).toArrow()
    return dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))


def vocabulary_of(counts: DataFrame, settings: Settings) -> Vocabulary:
    is_end = F.octet_length("word") == 0
    size = counts.agg(
        F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(is_end, F.col("n"))).alias("e")
    ).first()
    near = frequent_words(counts.filter(~is_end), settings.near_words)
    ordered = sorted(near, key=lambda w: (-near[w], w))
    out = Vocabulary(settings, int(size.n or 0), int(size.v), int(size.e or 0))
    out.rank = {w: k for k, w in enumerate(ordered)}
    out.count = np.fromiter((near[w] for w in ordered), np.int64, len(ordered))
    own = set(ordered[: settings.item_words]) | {END.encode()}

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column("word")
        other = np.fromiter((w not in own for w in words.to_pylist()), bool, len(words))
        kinds = types_of(words, settings.types)[other]
        n = batch.column("n").to_numpy()[other]
        distinct = np.bincount(kinds, minlength=settings.types)
        tokens = np.zeros(settings.types, np.int64)
        np.add.at(tokens, kinds, n)
        held = np.flatnonzero(distinct)
        columns = [pa.array(held), pa.array(tokens[held]), pa.array(distinct[held])]
        return pa.RecordBatch.from_arrays(columns, ["kind", "tokens", "words"])

    each = map_batches(counts, step, "kind bigint, tokens bigint, words bigint")
    sums = each.groupBy("kind").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).collect()
    out.type_tokens = np.zeros(settings.types, np.int64)
    out.type_words = np.zeros(settings.types, np.int64)
    for r in sums:
        out.type_tokens[r.kind], out.type_words[r.kind] = r.t, r.w
    return out


ITEM_SCHEMA = (
    "doc_id bigint, held_out boolean, items array<int>, n_known bigint, base_near double,"
    " within_near double, far array<struct<word: binary, n: bigint>>"
)


def as_items(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts as items (words, then the end), with the figures of the near words.

    ``far`` holds a text's words beyond the near ones, with their numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = shared.value
        n_own, first_type = v.n_own, 1 + v.settings.item_words
        counts = np.append(v.count, 0)
        lists, known, base, within, far_words, far_counts, far_at = [], [], [], [], [], [], [0]
        for _, _, data, offsets in slices(batch.column("text")):
            words, codes, at = token_slice(data, offsets)
            kinds = types_of(words, v.settings.types)
            words = words.to_pylist()
            rank = v.ranks(words)
            is_near, own = rank >= 0, (rank >= 0) & (rank < n_own)
            item = np.where(own, rank + 1, first_type + kinds).astype(np.int32)
            count = counts[rank]
            inside = np.where(is_near & ~own, v.within_type(kinds, count), 0.0)
            figure = np.where(is_near, v.base(count), 0.0)
            sums = [
                np.concatenate([[0], np.cumsum(x[codes])])
                for x in (is_near.astype(np.int64), figure, inside)
            ]
            a, b = at[:-1], at[1:]
            known.append(sums[0][b] - sums[0][a] + (v.ends > 0))
            base.append(sums[1][b] - sums[1][a] + v.base(v.ends))
            within.append(sums[2][b] - sums[2][a])
            ids = np.insert(item[codes], b, 0)
            lists.append(pa.ListArray.from_arrays(pa.array(at + np.arange(len(at)), pa.int32()), pa.array(ids)))
            row = np.repeat(np.arange(len(a)), b - a)
            far = np.flatnonzero(~is_near[codes])
            keys, n = np.unique(row[far] * max(len(words), 1) + codes[far], return_counts=True)
            far_words += [words[k] for k in (keys % max(len(words), 1)).tolist()]
            far_counts.append(n)
            per_row = np.bincount(keys // max(len(words), 1), minlength=len(a))
            far_at += (far_at[-1] + np.cumsum(per_row)).tolist()
        far = pa.ListArray.from_arrays(
            pa.array(far_at, pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(far_words, pa.binary()), pa.array(np.concatenate(far_counts), pa.int64())],
                ["word", "n"],
            ),
        )
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.concat_arrays(lists)]
        columns += [pa.array(np.concatenate(known), pa.int64())]
        columns += [pa.array(np.concatenate(base)), pa.array(np.concatenate(within)), far]
        names = "doc_id held_out items n_known base_near within_near far".split()
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs.select("doc_id", "held_out", "text"), step, ITEM_SCHEMA)


# --- classes ----------------------------------------------------------------


def contexts(items: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """How often a class stands before and after every item, over all training rows.

    A task adds up its rows; the sums of the tasks meet in a shuffle. The result has as
    many numbers as items times classes.
    """
    n = len(classes)
    shared = items.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        left = np.zeros(n * n_classes, np.int64)
        right = np.zeros(n * n_classes, np.int64)
        for batch in batches:
            lists = batch.column("items")
            ids = pc.list_flatten(lists).to_numpy().astype(np.int64)
            if not len(ids):
                continue
            # The item before a text's first is an end, as at every other place of a
            # row of texts: each ends with one.
            before = np.concatenate([[0], ids[:-1]])
            left += np.bincount(ids * n_classes + of[before], minlength=len(left))
            right += np.bincount(before * n_classes + of[ids], minlength=len(right))
        for side, sums in ((0, left), (1, right)):
            held = np.flatnonzero(sums)
            for at in range(0, len(held), 100_000):
                part = held[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), side, np.int32)), pa.array(part.astype(np.int32)), pa.array(sums[part])],
                    ["side", "place", "n"],
                )

    each = items.select("items").mapInArrow(run, "side int, place int, n bigint")
    sums = each.groupBy("side", "place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, n * n_classes))
    side, place, total = (sums.column(c).to_numpy() for c in ("side", "place", "n"))
    out[side, place] = total
    return out[0].reshape(n, n_classes), out[1].reshape(n, n_classes)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(classes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One sweep: every item moves to the class that raises the likelihood most.

    The likelihood is that of the class bigrams, sum of N log N over pairs of classes less
    those over single classes. Class counts follow every move; the classes of the
    neighbours are those of the last pass over the corpus. The end keeps its class, 0.
    """
    k = left.shape[1]
    classes = classes.copy()
    member = np.zeros((k, len(classes)))
    member[classes, np.arange(len(classes))] = 1
    after = member @ right
    before = member @ left
    weight = right.sum(axis=1)
    sizes = member @ weight
    order = np.argsort(-weight, kind="stable")
    for w in order:
        if w == 0 or not weight[w]:
            continue
        a = classes[w]
        after[a] -= right[w]
        before[a] -= left[w]
        sizes[a] -= weight[w]
        on_r, on_l = np.flatnonzero(right[w]), np.flatnonzero(left[w])
        gain = (xlogx(after[:, on_r] + right[w, on_r]) - xlogx(after[:, on_r])).sum(axis=1)
        gain += (xlogx(before[:, on_l] + left[w, on_l]) - xlogx(before[:, on_l])).sum(axis=1)
        gain -= 2 * (xlogx(sizes + weight[w]) - xlogx(sizes))
        gain[0] = -np.inf
        b = int(np.argmax(gain))
        classes[w] = b
        after[b] += right[w]
        before[b] += left[w]
        sizes[b] += weight[w]
    return classes


def first_classes(vocabulary: Vocabulary) -> np.ndarray:
    """Classes by the last bytes of a word, before any exchange."""
    s = vocabulary.settings
    out = np.zeros(vocabulary.n_items, np.int64)
    own = pa.array(list(vocabulary.rank)[: vocabulary.n_own], pa.large_binary())
    out[1 : 1 + len(own)] = 1 + types_of(own, s.types) % (s.classes - 1)
    at = 1 + s.item_words
    out[at:] = 1 + np.arange(s.types) % (s.classes - 1)
    return out


@dataclass
class Model:
    classes: np.ndarray
    #: log10 P(class | class before), log10 P(item | its class).
    transition: np.ndarray
    emission: np.ndarray


def fit(items: DataFrame, vocabulary: Vocabulary) -> Model:
    """Cluster the items of the training rows and set the probabilities."""
    s = vocabulary.settings
    training = items.filter("not held_out")
    classes = first_classes(vocabulary)
    left, right = contexts(training, classes, s.classes)
    for _ in range(s.sweeps):
        classes = exchange(classes, left, right)
        left, right = contexts(training, classes, s.classes)
    member = np.zeros((s.classes, len(classes)))
    member[classes, np.arange(len(classes))] = 1
    pairs = member @ right + s.transition_floor
    counts = left.sum(axis=1) + s.emission_floor
    counts[0] = max(left[0].sum(), s.emission_floor)
    return Model(
        classes,
        np.log10(pairs / pairs.sum(axis=1, keepdims=True)),
        np.log10(counts / (member @ counts)[classes]),
    )


def class_scores(items: DataFrame, model: Model) -> DataFrame:
    """``items`` with n_tokens and the log10 probability of its items."""
    shared = items.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        lists = batch.column("items")
        ids = pc.list_flatten(lists).to_numpy()
        sizes = pc.list_value_length(lists).to_numpy()
        of = m.classes[ids]
        before = np.concatenate([[0], of[:-1]])
        sums = np.concatenate([[0], np.cumsum(m.transition[before, of] + m.emission[ids])])
        at = np.concatenate([[0], np.cumsum(sizes)])
        columns = [batch.column(c) for c in names[:-2]]
        columns += [pa.array(sizes, pa.int64()), pa.array(sums[at[1:]] - sums[at[:-1]])]
        return pa.RecordBatch.from_arrays(columns, names)

    names = "row doc_id held_out n_known base_near within_near n_tokens item_score".split()
    schema = (
        "row bigint, doc_id bigint, held_out boolean, n_known bigint, base_near double,"
        " within_near double, n_tokens bigint, item_score double"
    )
    return map_batches(items.select(*names[:-2], "items"), step, schema)


def far_figures(items: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """row, and the figures of its words beyond the near ones, by a join with the counts."""
    shared = items.sparkSession.sparkContext.broadcast(vocabulary)
    words = items.select("row", F.explode("far").alias("w")).select("row", "w.word", F.col("w.n").alias("times"))
    joined = words.join(counts, "word", "left").select("row", "word", "times", F.coalesce("n", F.lit(0)).alias("n"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = shared.value
        times = batch.column("times").to_numpy()
        n = batch.column("n").to_numpy()
        inside = v.within_type(types_of(batch.column("word"), v.settings.types), n)
        columns = [batch.column("row"), pa.array(np.where(n > 0, times, 0))]
        columns += [pa.array(times * v.base(n)), pa.array(times * inside)]
        return pa.RecordBatch.from_arrays(columns, ["row", "known", "base", "inside"])

    each = map_batches(joined, step, "row bigint, known bigint, base double, inside double")
    return each.groupBy("row").agg(
        F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("inside").alias("inside")
    )


def score(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Log10 probabilities of every row of ``docs`` (doc_id, text) by model and by base.

    The rows with crc32(doc_id as text) mod 7 other than 2 are learnt from; a null id
    counts as an empty text (learnt from). Returns doc_id, held_out, n_tokens (words and
    end), n_known (tokens seen in training), train_tokens, base_score, score. Base: sum
    of log10((c + 1) / (N + V + 1)). Null texts are empty: one end. Repeated rows are
    learnt and scored each. Other columns are ignored; no rows give no rows; without any
    training row all tokens are unknown.
    """
    settings = settings or Settings()
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        held_out(F.col("doc_id")).alias("held_out"),
    )
    counts = stored(word_counts(rows.filter("not held_out")), "word-counts")
    vocabulary = vocabulary_of(counts, settings)
    items = as_items(rows, vocabulary).withColumn("row", F.monotonically_increasing_id())
    items = stored(items, "items")
    model = fit(items, vocabulary)
    far = far_figures(items, counts, vocabulary)
    joined = class_scores(items, model).join(far, "row", "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + part("known")).alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("base_near") + part("base")).alias("base_score"),
        (F.col("item_score") + F.col("within_near") + part("inside")).alias("score"),
    )
