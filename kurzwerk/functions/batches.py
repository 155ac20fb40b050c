"""Steps of bounded size within an Arrow batch, so that its rows never grow all at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of one Arrow batch on its way to a Python worker, unless the session says otherwise.
BATCH_BYTES = "8m"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
C_LIBRARY = ctypes.CDLL(None)


def bound_batches(spark: SparkSession) -> None:
    """Let batches end by their bytes too; 10,000 long rows are many megabytes."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(first, next) of runs of rows whose sizes sum up to ``limit``; a larger row is alone."""
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        last = max(int(np.searchsorted(ends, before + limit, "right")), first + 1)
        yield first, last
        first = last


def release() -> None:
    """Give memory that was freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(C_LIBRARY, "malloc_trim", None)
    if trim:
        trim(0)
