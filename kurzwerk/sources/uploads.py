"""Uploads: folders of files, tables of data URLs, and page extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kurzwerk.params import Params
from kurzwerk.sources import folder

PAGES = pa.struct([("pages", pa.list_(pa.string())), ("error", pa.string())])
Extractor = Callable[[Column], Column]


def read_files(
    spark: SparkSession, path: str, params: Params = Params(), tasks: int | None = None
) -> DataFrame:
    """``path, filename, size, content`` of every file below a folder.

    The folder is listed once, in tasks. Only files with the allowed ending and within
    the size limit are opened; the others, and files of no bytes, are rows all the same.
    The listed paths are dealt over ``tasks`` tasks before any file is read, so that a
    folder with most of the files is not the work of one.
    """
    listing = folder.list_files(spark, path)
    return contents_of(listing, params, tasks)


def stream_files(
    spark: SparkSession, path: str, params: Params = Params(), tasks: int | None = None, **options
) -> DataFrame:
    """The same as a stream: each batch has the files written since the one before."""
    return contents_of(folder.stream_files(spark, path, **options), params, tasks)


def contents_of(listing: DataFrame, params: Params, tasks: int | None) -> DataFrame:
    tasks = tasks or 4 * listing.sparkSession.sparkContext.defaultParallelism
    dealt = listing.repartition(tasks, "path")
    return folder.with_contents(dealt, params.allowed_extension, params.max_file_size)


def plain_text_pages(separator: str = "\f") -> Extractor:
    """Extractor for UTF-8 text whose pages are parted by ``separator``; runs in the JVM."""

    def extract(content: Column) -> Column:
        text = F.try_validate_utf8(content.cast("string"))
        return F.struct(
            F.split(text, f"\\Q{separator}\\E", -1).alias("pages"),
            F.when(content.isNotNull() & text.isNull(), "not UTF-8").alias("error"),
        )

    return extract


def open_pages(open_file: Callable[[bytes], Iterable], content: bytes | None) -> dict:
    """Page texts of one file; a page that fails is null, a file that fails is an error."""
    if content is None:
        return {"pages": None, "error": None}
    texts: list = []
    try:
        for page in open_file(bytes(content)):
            try:
                texts.append(page() if callable(page) else page)
            except Exception:  # noqa: BLE001 - one bad page must not fail the file
                texts.append(None)
    except Exception as exc:  # noqa: BLE001 - any reader error means "unreadable"
        return {"pages": None, "error": f"{type(exc).__name__}: {exc}"}
    return {"pages": texts, "error": None}


def python_pages(open_file: Callable[[bytes], Iterable]) -> Extractor:
    """Extractor from a Python reader: bytes -> pages, each a text, null or callable."""

    @F.arrow_udf("struct<pages:array<string>,error:string>")
    def extract(contents: pa.Array) -> pa.Array:
        return pa.array([open_pages(open_file, c) for c in contents.to_pylist()], PAGES)

    return extract.asNondeterministic()


def pypdf_reader(content: bytes) -> list:
    """Pages of a PDF through the ``pypdf`` package, if the executors have it."""
    import io

    from pypdf import PdfReader

    return [page.extract_text for page in PdfReader(io.BytesIO(content)).pages]
