"""Incremental intake: uploads are validated, extracted and cleaned as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kurzwerk.params import Params
from kurzwerk.plans.intake import classify_uploads
from kurzwerk.sources.uploads import Extractor


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    files: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New Parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_intake(
    uploads: DataFrame,
    extractor: Extractor,
    output: str,
    checkpoint: str,
    params: Params = Params(),
    keys: Sequence[str] = (),
) -> StreamingQuery:
    """Classify a stream of uploads into a Parquet table, each upload exactly once.

    The outcome of an upload needs that row alone, so the stream has no state.
    """
    return (
        classify_uploads(uploads, extractor, params, keys)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
