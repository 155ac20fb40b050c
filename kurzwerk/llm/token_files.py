"""Token ids as framed binary records with checksums, and an index for shuffled reads.

A data file is a run of records. A record is: length of the body (8 bytes), masked
checksum of the length (4), body, masked checksum of the body (4); all little-endian.
A body is one document: null flag (1 byte), doc_id (8, signed), number of ids (8), bytes
per id (1: 2 or 4), and the ids packed by zstd. The index of a data file has 24 bytes per
record: offset of the record, first id's place within the file, number of ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kurzwerk.llm.common import filesystem, ragged_take, slices, stored
from kurzwerk.llm.word_pieces import coded_words
from kurzwerk.session import work_dir

#: The mask of the checksums in this kind of file.
MASK_DELTA = 0xA282EAD8
BODY_HEAD = struct.Struct("<?qQB")
INDEX_ENTRY = struct.Struct("<QQQ")
CACHE_WORDS = 600_000
#: Distinct words that go to the tokenizer as one text.
JOINED_WORDS = 512


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    size = struct.pack("<Q", len(body))
    return size + struct.pack("<I", masked(size)) + body + struct.pack("<I", masked(body))


def read_frame(stream) -> bytes | None:
    """The next body, None at the end; raises ValueError on damage."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    rest = stream.read(size + 4)
    if len(rest) < size + 4 or struct.unpack("<I", rest[size:])[0] != masked(rest[:size]):
        raise ValueError("damaged record body")
    return rest[:size]


def body_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    import zstandard

    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    raw = ids.astype(f"<u{wide}").tobytes()
    head = BODY_HEAD.pack(doc_id is None, doc_id or 0, len(ids), wide)
    return head + zstandard.ZstdCompressor(level=1).compress(raw)


def parse_body(body: bytes) -> tuple[int | None, np.ndarray]:
    import zstandard

    null, doc_id, n, wide = BODY_HEAD.unpack(body[: BODY_HEAD.size])
    raw = zstandard.ZstdDecompressor().decompress(body[BODY_HEAD.size :], max_output_size=n * wide)
    ids = np.frombuffer(raw, f"<u{wide}")
    if len(ids) != n:
        raise ValueError("damaged ids")
    return None if null else doc_id, ids


class WordIds:
    """Ids of texts by a tokenizer file that ignores case, drops blanks and parts letters.

    The ids of a text are those of its words, one after another, so each distinct word
    is encoded once and remembered. Unknown words go to the library many at a time, as
    one text; it tells whose each id is. When the memory is full,
    words that did not occur since it was half full are dropped.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        #: Number of a word; its ids are flat[starts[number] : starts[number + 1]].
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(CACHE_WORDS + 1, np.int64)
        self.seen = np.zeros(CACHE_WORDS, bool)

    def remember(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Append words; the buffers grow to twice their size when they are full."""
        known = len(self.number)
        if known < CACHE_WORDS // 2 <= known + len(words):
            self.seen[:known] = False
        if known + len(words) >= len(self.starts):
            more = known + len(words) + 1 - len(self.starts)
            self.starts = np.concatenate([self.starts, np.zeros(more, np.int64)])
            self.seen = np.concatenate([self.seen, np.zeros(more, bool)])
        first = self.starts[known]
        if first + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[first : first + len(ids)] = ids
        self.starts[known + 1 : known + 1 + len(words)] = first + np.cumsum(sizes)
        self.number.update(zip(words, range(known, known + len(words))))

    def drop_unseen(self) -> None:
        words = [w for w, k in self.number.items() if self.seen[k]]
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        first, sizes = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ids = ragged_take(self.flat, first, sizes)
        self.forget()
        if len(words) <= CACHE_WORDS // 2:
            self.remember(words, sizes, ids)

    def encode_words(self, words: list[str]) -> None:
        """Encode and remember words that are unknown.

        A text of words of Latin-1 letters, a blank between, has them as its pre-tokens,
        which costs half of what words given one by one cost.
        """
        bare = [w.strip(" \n") for w in words]
        plain = [k for k, w in enumerate(bare) if w.isalpha() and max(w) <= "\xff"]
        for joined, chosen in ((True, plain), (False, sorted(set(range(len(words))).difference(plain)))):
            parts = [chosen[k : k + JOINED_WORDS] for k in range(0, len(chosen), JOINED_WORDS)]
            texts = [[bare[k] for k in part] for part in parts]
            encoded = self.tokenizer.encode_batch(
                [" ".join(text) for text in texts] if joined else texts,
                is_pretokenized=not joined,
                add_special_tokens=False,
            )
            flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for part, done in zip(parts, encoded):
                flat.append(np.array(done.ids, np.uint32))
                sizes.append(np.bincount(np.array(done.word_ids, np.int64), minlength=len(part)))
                if len(sizes[-1]) != len(part):
                    raise ValueError("the tokenizer parts words of letters")
            self.remember([words[k] for k in chosen], np.concatenate(sizes), np.concatenate(flat))

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, codes, at = coded_words(data, offsets, caseless=True)
        if len(self.number) + len(words) > CACHE_WORDS:
            self.drop_unseen()
        self.encode_words([w for w in words if w not in self.number])
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.seen[numbers] = True
        first = self.starts[numbers]
        sizes = (self.starts[numbers + 1] - first)[codes]
        first = first[codes]
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        return ragged_take(self.flat, first, sizes), ends[at]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every row."""
        for _, _, data, offsets in slices(texts):
            ids, at = self.encode_slice(data, offsets)
            for a, b in zip(at, at[1:]):
                yield ids[a:b]


#: Tokenizers of this process, by file.
LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in LOADED:
        LOADED[path] = WordIds(path)
    return LOADED[path]


class Output:
    """One data file and its index."""

    def __init__(self, fs, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.rec"
        self.data = fs.open_output_stream(self.path, compression=None)
        self.index = fs.open_output_stream(self.path + ".idx", compression=None)
        self.size = self.ids = self.count = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        record = frame(body_of(doc_id, ids))
        self.data.write(record)
        self.index.write(INDEX_ENTRY.pack(self.size, self.ids, len(ids)))
        self.size, self.ids, self.count = self.size + len(record), self.ids + len(ids), self.count + 1

    def close(self) -> None:
        self.data.close()
        self.index.close()


FILES = "part int, file_no int, file string, n_records bigint, n_ids bigint"


def write_token_files(
    docs: DataFrame, path: str, place: str, end_id: int, file_bytes: int = 256 << 20
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them below ``place`` by ascending doc_id.

    The texts are range-partitioned by doc_id (rows without one come first; rows of one
    doc_id in the order of their texts), so a file covers a range and files are ordered
    by (part, file_no). ``end_id`` follows every document; a null text has no other id.
    Attempts of a task never share a file name; the result is the table of the files
    that count.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ranged = ranged.withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(place)
        fs.create_dir(folder, recursive=True)
        out, part, done = None, 0, []
        end = np.array([end_id], np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            ids = word_ids(path).encode(batch.column("text"))
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), ids):
                out = out or Output(fs, folder)
                out.add(doc_id, np.append(found, end))
                if out.size >= file_bytes:
                    out.close()
                    done.append((part, len(done), out.path, out.count, out.ids))
                    out = None
        if out:
            out.close()
            done.append((part, len(done), out.path, out.count, out.ids))
        if done:
            columns = [pa.array(c) for c in zip(*done)]
            columns[:2] = [c.cast(pa.int32()) for c in columns[:2]]
            yield pa.RecordBatch.from_arrays(columns, ["part", "file_no", "file", "n_records", "n_ids"])

    return ranged.mapInArrow(write, FILES)


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start within its file, and ids (little-endian, 4 bytes each) of every record.

    Reads each file front to back; a record that fails its checksums raises.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, first in zip(batch["file"], batch["first_id"]):
                fs, path = filesystem(file)
                rows, size, start = [], 0, int(first)
                with fs.open_input_stream(path, compression=None) as stream:
                    while (body := read_frame(stream)) is not None:
                        doc_id, ids = parse_body(body)
                        rows.append((doc_id, start, ids.astype("<u4").tobytes()))
                        start, size = start + len(ids), size + 4 * len(ids)
                        if size > 8 << 20:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["doc_id", "start", "ids"])
        return frame.astype({"doc_id": "Int64"})

    return files.mapInPandas(read, "doc_id bigint, start bigint, ids binary")


def record_at(place: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number within a file, by the index: the shuffled read."""
    fs, path = filesystem(place)
    with fs.open_input_file(path + ".idx") as index:
        index.seek(number * INDEX_ENTRY.size)
        offset, _, _ = INDEX_ENTRY.unpack(index.read(INDEX_ENTRY.size))
    with fs.open_input_file(path) as data:
        data.seek(offset)
        return parse_body(read_frame(data))


def placed(files: DataFrame) -> DataFrame:
    """The file table with the number of ids in all files before each.

    The window has one row per file, not per document.
    """
    order = W.orderBy("part", "file_no").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def roundtrip(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files in the shared work folder and read them back."""
    files = stored(
        write_token_files(docs, path, work_dir(spark, "token-files"), end_id), "token-file-list"
    )
    n = max(1, files.count())
    read = read_token_files(placed(files).repartition(n, "file"))
    return read.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
