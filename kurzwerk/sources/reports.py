"""Report files, and tables that end a long plan."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_report(report: DataFrame, path: str) -> None:
    """The one-row report as a file with one JSON object, UTF-8 as it is.

    It is written beside its place and renamed, so a reader sees the old report or the
    new one. A report of another number of rows is refused and nothing is written.
    """
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a report has one row, not {'none' if not rows else 'several'}")
    text = json.dumps(rows[0].asDict(recursive=True), ensure_ascii=False, indent=2, default=str)
    replace_file(report.sparkSession, path, text.encode())


def replace_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Put a small file at ``path``, on any file system Spark knows, in one step."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    files = target.getFileSystem(conf)
    if files.getScheme() == "file":
        files = files.getRawFileSystem()  # no checksum file beside it
    target = files.makeQualified(target)
    fresh = hadoop.Path(target.getParent(), f"_{target.getName()}.{uuid.uuid4().hex}")
    files.mkdirs(target.getParent())
    try:
        out = files.create(fresh, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if files.exists(target) and files.getFileStatus(target).isDirectory():
            files.delete(target, True)
        rename = hadoop.Options.Rename
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(fresh, target, how)
    except BaseException:
        files.delete(fresh, False)
        raise


def write_detail(detail: DataFrame, path: str) -> None:
    """The detail table as CSV with a header; one file per partition."""
    detail.write.mode("overwrite").option("header", True).csv(path)


def write_evaluation(detail: DataFrame, report: DataFrame, path: str) -> None:
    """Both side by side: ``<path>.json`` and ``<path>.csv``."""
    write_report(report, f"{path}.json")
    write_detail(detail, f"{path}.csv")


def read_report(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_detail(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` below the shared work folder and go on from the written table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
