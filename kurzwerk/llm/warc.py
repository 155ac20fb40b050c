"""WARC archives: a writer, and a reader that salvages what damaged files still hold."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kurzwerk.llm.common import filesystem, stored
from kurzwerk.session import work_dir

VERSION = b"WARC/1.0"
GZIP_MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"WARC/[0-9]|" + re.escape(GZIP_MAGIC))
READ_BYTES = 1 << 20
#: Larger than what a row can hold, so that it only bounds what damage makes a task unpack.
MEMBER_BYTES = 4 << 30
#: A head that is longer than this and holds bytes that no text has is damage.
HEAD_BYTES = 64 << 10
NO_TEXT = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
PAGE_ID = "X-Page-Id"
REFERS_TO_ID = "X-Refers-To-Page-Id"
PAYLOAD_LENGTH = "X-Payload-Length"

RECORD_SCHEMA = (
    "file string, start bigint, end bigint, fault string, record_type string, headers map<string,"
    "string>, payload binary"
)


# --- writing ----------------------------------------------------------------


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(row, packed: bool = True) -> bytes:
    """One record: a gzip member of its own, or plain."""
    payload = row.payload if row.record_type == "response" else b""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row.url or "")
    head = [
        VERSION.decode(),
        f"WARC-Type: {row.record_type}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row.record_key)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32(row.payload_digest)}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(payload).hexdigest())}",
        f"{PAYLOAD_LENGTH}: {row.payload_bytes}",
    ]
    if not pd.isna(row.page_id):
        head.append(f"{PAGE_ID}: {int(row.page_id)}")
    if not pd.isna(row.refers_to):
        head.append(f"{REFERS_TO_ID}: {int(row.refers_to)}")
    head.append(f"Content-Length: {len(payload)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    if not packed:
        return raw
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def with_types(pages: DataFrame, least: int) -> DataFrame:
    """Pages with payload, digest and record type.

    The largest page of each payload comes from partial aggregates; joined back on the
    digest, where payloads below ``least`` bytes take no part (their key is their own).
    """
    base = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    base = base.withColumn("payload_digest", F.sha1("payload"))
    shared = (
        base.filter(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("shared_digest"))
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("shared_digest", "first_id")
    )
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "payload_digest").cast("string"))
    key = F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(own)
    typed = base.withColumn("shared_digest", key).join(shared, "shared_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return typed.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def write_warc(
    pages: DataFrame, place: str, least: int = 1000, file_bytes: int = 256 << 20
) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below ``place``.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest
    page_id is the response and the others are revisits of it; should one page_id hold
    that payload several times, all those rows are responses. Smaller payloads are
    responses. A null html is an empty payload; rows without page_id are never
    referred to while another has one. Each task writes files of its own (attempts
    never share a name) and returns them; the result is the table of the files that
    count: file, n_records, n_bytes.
    """
    typed = with_types(pages, least)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = filesystem(place)
        out, path, size, count = None, "", 0, 0
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                packed = record_bytes(row)
                out.write(packed)
                size, count = size + len(packed), count + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"file": [path], "n_records": [count], "n_bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [path], "n_records": [count], "n_bytes": [size]})

    key = F.concat_ws(
        "/", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "payload_digest"
    )
    rows = typed.withColumn("record_key", key)
    return rows.mapInPandas(write, "file string, n_records bigint, n_bytes bigint")


# --- reading ----------------------------------------------------------------


class Window:
    """A file seen through a buffer: only the bytes from ``start`` on are held."""

    def __init__(self, stream):
        self.stream, self.start, self.data, self.over = stream, 0, b"", False

    def fill(self, n: int) -> bool:
        """Hold at least n bytes, if there are so many."""
        while len(self.data) < n and not self.over:
            more = self.stream.read(max(READ_BYTES, n - len(self.data)))
            self.over = not more
            self.data += more
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        self.data = self.data[n:]
        self.start += n


class Damage(Exception):
    pass


class Truncated(Damage):
    pass


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, bytes used) of the record at the start of ``raw``.

    None: more bytes are needed. Raises Damage if this is no valid record.
    """
    if not raw[:5] == b"WARC/"[: len(raw[:5])]:
        raise Damage("no version line")
    stop = raw.find(b"\r\n\r\n")
    if stop < 0 or stop > HEAD_BYTES:
        if len(raw) > HEAD_BYTES and NO_TEXT.search(raw, 0, stop if stop >= 0 else len(raw)):
            raise Damage("head without end")
        if stop < 0:
            return None
    lines = raw[:stop].split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        raise Damage("bad version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("bad head line")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode(
            "utf-8", "replace"
        )
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", size):
        raise Damage("no content length")
    begin, end = stop + 4, stop + 4 + int(size)
    if len(raw) < end + 4:
        return None
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Damage("record end not where its length says")
    block = raw[begin:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:"):
        found = hashlib.sha1(block)
        if digest[5:] not in (base64.b32encode(found.digest()).decode(), found.hexdigest()):
            raise Damage("block digest differs")
    return headers, block, end + 4


def plain_record(window: Window) -> tuple[list, int]:
    n = 1 << 12
    while True:
        enough = window.fill(n)
        found = parse_record(window.data)
        if found:
            return [found[:2]], found[2]
        if not enough:
            raise Truncated("record cut off")
        n = 2 * len(window.data)


def member_records(window: Window, most: int) -> tuple[list, int]:
    """The records of the gzip member at the start of the window, and its length."""
    unpack = zlib.decompressobj(31)
    used, raw, held = 0, bytearray(), []
    while not unpack.eof:
        if not window.fill(used + 1):
            raise Truncated("member cut off")
        part = window.data[used : used + READ_BYTES]
        try:
            raw += unpack.decompress(part, most + 1 - len(raw))
        except zlib.error as fault:
            raise Damage(f"member: {fault}") from fault
        if len(raw) > most:
            raise Damage("member larger than the limit")
        used += len(part) - len(unpack.unconsumed_tail) - len(unpack.unused_data)
    raw = bytes(raw)
    while raw:
        found = parse_record(raw)
        if not found:
            raise Damage("record cut off within its member")
        held.append(found[:2])
        raw = raw[found[2] :]
    return held, used


def next_start(window: Window) -> int | None:
    """Bytes to the next place after this one that looks like a member or version line.

    A version line need not follow a line feed: a damaged member may stand before it.
    Whether a record is there the full parse decides.
    """
    while True:
        window.fill(1 + READ_BYTES)
        found = START.search(window.data, 1)
        if found:
            return found.start()
        if window.over:
            return None
        window.drop(len(window.data) - 8)


def salvage(stream, most: int = MEMBER_BYTES) -> Iterator[tuple[int, int, str | None, list]]:
    """(start, end, fault, records) of a file of plain and packed records, mixed at will.

    Where a record or member fails its checks, its bytes up to the next place with a
    valid one are one gap, reported with the fault of the first failure.
    """
    window = Window(stream)
    gap: tuple[int, str] | None = None
    while window.fill(1):
        window.fill(3)
        begin = window.start
        try:
            if window.data[:3] == GZIP_MAGIC:
                records, used = member_records(window, most)
            else:
                records, used = plain_record(window)
        except Damage as fault:
            gap = gap or (begin, str(fault))
            ahead = next_start(window)
            if ahead is None:
                window.drop(len(window.data))
                break
            window.drop(ahead)
            continue
        if gap:
            yield gap[0], begin, gap[1], []
            gap = None
        window.drop(used)
        yield begin, window.start, None, records
    if gap:
        yield gap[0], window.start, gap[1], []


def read_warc(files: DataFrame, most: int = MEMBER_BYTES, whole: bool = False) -> DataFrame:
    """Records and quarantined gaps of the archives in column ``file``.

    One row per record (fault null) or gap (fault says why; record_type, headers and
    payload null), with the byte range in its file. A file is read as a stream, one
    record at a time; ``most`` bounds the unpacked size of a member. Missing or empty
    files of nonzero name give a gap of no bytes and no rows, respectively.

    With ``whole``, the files are those of a table of ``write_warc``: a missing file, a
    gap, or another number of records than the table's ``n_records`` stops the job.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, expected in zip(batch["file"], batch["n_records"]):
                if file is None:
                    continue
                rows, size, count = [], 0, 0
                fs, path = filesystem(file)
                try:
                    stream = fs.open_input_stream(path, compression=None)
                except FileNotFoundError:
                    if whole:
                        raise
                    rows.append((file, 0, 0, "no such file", None, None, None))
                else:
                    with stream:
                        for start, end, fault, records in salvage(stream, most):
                            if fault and whole:
                                raise ValueError(f"{file}, bytes {start} to {end}: {fault}")
                            if fault:
                                rows.append((file, start, end, fault, None, None, None))
                            for head, block in records:
                                kind = head.get("warc-type")
                                rows.append((file, start, end, None, kind, head, block))
                                size += len(block)
                            count += len(records)
                            if size > 8 << 20 or len(rows) >= 5000:
                                yield frame(rows)
                                rows, size = [], 0
                if whole and count != expected:
                    raise ValueError(f"{file}: {count} records of {expected}")
                if rows:
                    yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        names = [c.split()[0] for c in RECORD_SCHEMA.replace("map<string,string>", "m").split(", ")]
        return pd.DataFrame(rows, columns=names)

    counts = F.col("n_records") if whole else F.lit(0)
    return files.select("file", counts.alias("n_records")).mapInPandas(read, RECORD_SCHEMA)


def page_records(records: DataFrame) -> DataFrame:
    """Per record of ``write_warc``: ids, and size and digest of the full payload.

    For responses both are taken from the payload itself; revisits carry none, theirs
    come from the head.
    """
    head = lambda name: F.element_at("headers", name.lower())
    kept = F.col("record_type") == "response"
    told = F.substring_index(head("WARC-Payload-Digest"), ":", -1)
    return records.filter("fault is null").select(
        head(PAGE_ID).cast("bigint").alias("page_id"),
        F.when(kept, F.octet_length("payload")).otherwise(head(PAYLOAD_LENGTH))
        .cast("bigint").alias("payload_bytes"),
        F.when(kept, F.sha1("payload")).otherwise(from_base32(told)).alias("payload_digest"),
        "record_type",
        head(REFERS_TO_ID).cast("bigint").alias("refers_to"),
    )


def from_base32(text):
    """Lower-case hex of a base32 digest, in SQL functions."""
    values = F.transform(
        F.split(text, ""),
        lambda c: F.lpad(
            F.bin(F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), c) - 1), 5, "0"
        ),
    )
    bits = F.array_join(values, "")
    nibbles = F.transform(
        F.sequence(F.lit(0), F.lit(39)),
        lambda k: F.lower(F.conv(F.substring(bits, k * 4 + 1, F.lit(4)), 2, 16)),
    )
    return F.array_join(nibbles, "")


def roundtrip(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages`` as archives in the shared work folder and read them back.

    One row per page: null html is an empty payload, null ids and urls are allowed,
    repeated rows are records each, other columns are ignored, no rows give no rows, and
    urls and payloads may be of any length. A record that does not come back stops the
    job.
    """
    files = stored(write_warc(pages, work_dir(spark, "warc"), least), "warc-files")
    n = max(1, files.count())
    return page_records(read_warc(files.repartition(n), whole=True))
