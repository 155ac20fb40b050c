"""Fill-in-middle form of documents, cut at the captures of one repeated group."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kurzwerk.llm.common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: One code point, whatever it is.
CODE_POINT = r"(?s:.)"

SCHEMA = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
)


@dataclass(frozen=True)
class Rates:
    """Per cent of texts that are transformed, and of these in suffix-first order."""

    transformed: int = 90
    suffix_first: int = 20


@lru_cache(64)
def repeated(unit: str) -> regex.Pattern:
    """The whole text as one group that repeats; a match holds every repetition.

    Possessive, so that a long text leaves no states to return to.
    """
    return regex.compile(rf"({unit})*+")


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that belong to an id: the first groups of a digest."""
    seed = "1:" if doc_id is None else f"1:{doc_id}"
    digest = hashlib.sha256(seed.encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(doc_id: int | None, text: str, unit: str, rates: Rates):
    """(units, form, characters of the prefix, of the middle, output) of one text.

    A text that is no sequence of units is an error of the unit's pattern.
    """
    found = repeated(unit).fullmatch(text)
    if found is None:
        raise ValueError("the text is no sequence of units")
    ends = found.ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id)
    marked = any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or h3 % 100 >= rates.transformed:
        return n, PLAIN, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a = ends[first - 1] if first else 0
    b = ends[second - 1] if second else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < rates.suffix_first:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of.

    A transformed text holds no mark and marks do not overlap each other, so the first
    place of each mark is the one that was put there.
    """
    if form == PLAIN:
        return output
    marks = (PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE)
    if not output.startswith(marks[0]):
        raise ValueError("the output does not start with its mark")
    second = output.index(marks[1])
    third = output.index(marks[2], second)
    one = output[len(marks[0]) : second]
    two = output[second + len(marks[1]) : third]
    middle = output[third + len(marks[2]) :]
    return one + middle + two if form == PSM else two + middle + one


def plain(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def forms(batch: pa.RecordBatch, unit: str, rates: Rates):
    """Row by row, so that only one text's captures are held at a time."""
    for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
        yield doc_id.as_py(), transform(doc_id.as_py(), text.as_py() or "", unit, rates)


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, rates: Rates = Rates()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) rewritten so that a middle part comes last.

    ``unit`` is a pattern whose repetitions make up any text (code points by default;
    words with the space before them, lines); cuts fall between units and are drawn
    from the digest of the id, so a rerun gives the same rows. ``n`` counts the units.

    A null text counts as empty; empty texts and texts that hold a mark stay plain, with
    null sizes. A null id has draws of its own. Repeated rows are rewritten each; other
    columns are ignored; no rows give no rows. Row-local. A unit takes some 50 bytes
    while its text is handled.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(doc_id, *made) for doc_id, made in forms(batch, unit, rates)]
        return batch_of(rows, SCHEMA)

    return map_batches(plain(docs), step, SCHEMA)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    columns = [pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


DIGESTS = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint,"
    " output_sha256 string, restored_sha256 string"
)


def digests(docs: DataFrame, unit: str = CODE_POINT, rates: Rates = Rates()) -> DataFrame:
    """Like ``fill_in_middle``, with digests of the output and of the text restored from it."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, (n, form, a, m, output) in forms(batch, unit, rates):
            rows.append((doc_id, n, form, a, m, sha(output), sha(restore(output, form))))
        return batch_of(rows, DIGESTS)

    return map_batches(plain(docs), step, DIGESTS)
