"""Files of a folder as a data source: listed in tasks, in batch and as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

from kurzwerk.session import ship_package

FORMAT = "folder_listing"
LISTING = "path string, filename string, size bigint, modified_ns bigint"
CONTENTS = "path string, filename string, size bigint, content binary"
#: Rows and bytes of content after which a task hands a batch on.
BATCH_ROWS, BATCH_BYTES = 5_000, 32 << 20

#: Filters that a listing decides itself, each as a test of a value.
TESTS: dict[type, Callable] = {
    EqualTo: lambda mine, given: mine == given,
    GreaterThan: lambda mine, given: mine > given,
    GreaterThanOrEqual: lambda mine, given: mine >= given,
    LessThan: lambda mine, given: mine < given,
    LessThanOrEqual: lambda mine, given: mine <= given,
    StringEndsWith: lambda mine, given: mine.endswith(given),
    StringStartsWith: lambda mine, given: mine.startswith(given),
}


def opened(place: str):
    """(file system, path in it, what stands before that path in the place)."""
    from pyarrow import fs

    if place.startswith("file:"):
        place = "/" + place.removeprefix("file:").lstrip("/")
    if "://" not in place:
        return fs.LocalFileSystem(), place.rstrip("/") or "/", ""
    system, path = fs.FileSystem.from_uri(place)
    return system, path.rstrip("/"), place.split("://", 1)[0] + "://"


def visible(name: str) -> bool:
    return not name.startswith((".", "_"))


def entries(place: str) -> tuple[list[tuple], list[str]]:
    """(files as (path, name, size, modified), sub-folders) of one folder, without hidden ones."""
    from pyarrow import fs

    system, path, scheme = opened(place)
    files, folders = [], []
    for info in system.get_file_info(fs.FileSelector(path, recursive=False)):
        if not visible(info.base_name):
            continue
        if info.type == fs.FileType.Directory:
            folders.append(scheme + info.path)
        elif info.type == fs.FileType.File:
            files.append((scheme + info.path, info.base_name, info.size, info.mtime_ns or 0))
    return files, folders


@dataclass
class Part(InputPartition):
    """One folder, with or without what is below it, and the time of its files."""

    folder: str
    below: bool
    after: int | None = None
    until: int | None = None

    def files(self) -> Iterator[tuple]:
        waiting = [self.folder]
        while waiting:
            files, folders = entries(waiting.pop())
            for file in files:
                if self.after is None or self.after < file[3] <= self.until:
                    yield file
            if self.below:
                waiting += folders


def parts_of(
    place: str, levels: int, after: int | None = None, until: int | None = None
) -> list[Part]:
    """A part per folder that lies ``levels`` deep, and one per folder above for its own files."""
    parts, heads = [], [place]
    for _ in range(levels):
        below = [entries(folder)[1] for folder in heads]
        parts += [Part(folder, False, after, until) for folder in heads]
        heads = [folder for folders in below for folder in folders]
    return parts + [Part(folder, True, after, until) for folder in heads]


def batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded rows, and of bounded bytes of content."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[3] or b"") if pa.types.is_binary(schema.types[3]) else 0
        if len(held) >= BATCH_ROWS or weight >= BATCH_BYTES:
            yield batch_of(held, schema)
            held, weight = [], 0
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(v, t) for v, t in zip(zip(*rows), schema.types)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in ddl.split(", ")]
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


class FolderSource(DataSource):
    """``spark.read.format("folder_listing").load(path)`` after ``register(spark)``.

    One row per file below ``path``: path, filename, size, modified_ns (files of no bytes
    included; names that start with a dot or an underscore are passed over). The driver
    lists the top ``levels`` (1) only; everything below is listed in tasks, a task per
    sub-folder.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> "FolderReader":
        return FolderReader(self.options)

    def streamReader(self, schema) -> "FolderStreamReader":
        return FolderStreamReader(self.options)


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.levels = options["path"], int(options.get("levels", "1"))
        self.tests: list[tuple[int, Callable, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of size, name, path and time are decided while listing."""
        names = [c.split()[0] for c in LISTING.split(", ")]
        for given in filters:
            test = TESTS.get(type(given))
            if isinstance(given, IsNotNull):  # nothing in a listing is null
                continue
            if test and given.attribute[0] in names:
                self.tests.append((names.index(given.attribute[0]), test, given.value))
            else:
                yield given

    def partitions(self) -> list[Part]:
        return parts_of(self.path, self.levels)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        wanted = (
            file
            for file in partition.files()
            if all(test(file[k], value) for k, test, value in self.tests)
        )
        return batches(wanted, arrow_schema(LISTING))


class FolderStreamReader(DataSourceStreamReader):
    """Files by the time they were last written.

    An offset is a point in time, so the driver neither lists files nor remembers them:
    a batch takes the files written after the last offset up to its own, and a repeated
    batch the same ones. Files that show up with an older time than a past offset are
    not seen; ``lag_seconds`` (0) keeps offsets that far behind the clock for stores
    that show files late.
    """

    def __init__(self, options):
        self.path, self.levels = options["path"], int(options.get("levels", "1"))
        self.lag = int(float(options.get("lag_seconds", "0")) * 1e9)

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.lag}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts_of(self.path, self.levels, start["until"], end["until"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return batches(partition.files(), arrow_schema(LISTING))

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make the source known; turns on that sources in Python are given filters."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)


def list_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Listing of every file below a folder, as a batch."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(path)


def stream_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same as a stream of new files."""
    register(spark)
    return spark.readStream.format(FORMAT).options(**options).load(path)


def with_contents(listing: DataFrame, ending: str, most: int) -> DataFrame:
    """``path, filename, size, content`` of listed files, row by row.

    Files with the ending (in any case) and of at most ``most`` bytes are opened, one
    after another; the others are rows without content. A file that is gone by then
    stops the job.
    """
    ending = ending.lower()

    def load(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for path, name, size in zip(*(part.column(c).to_pylist() for c in range(3))):
                    content = None
                    if name.lower().endswith(ending) and size <= most:
                        system, inner, _ = opened(path)
                        with system.open_input_stream(inner) as file:
                            content = file.read()
                    yield path, name, size, content

        return batches(rows(), arrow_schema(CONTENTS))

    return listing.select("path", "filename", "size").mapInArrow(load, CONTENTS)
