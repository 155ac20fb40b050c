"""Session set-up, shipping of the package to executors, shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

from kurzwerk.functions.batches import bound_batches


def local_session(cpus: int = 8, name: str = "kurzwerk") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Batches on their way to them are bounded by bytes too, if the session sets no bound.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    if any(str(f).endswith("kurzwerk.zip") for f in sc.listFiles):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="kurzwerk-ship-"), "kurzwerk.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder the cluster names.

    ``spark.checkpoint.dir`` decides; only where it is unset (tests on one
    machine) a temporary folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="kurzwerk-")
    return f"{base.rstrip('/')}/kurzwerk/{purpose}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession, place: str) -> None:
    """Delete a folder made by ``work_dir``, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scale_settings(input_bytes: int, partition_bytes: int = 128 * 1024 * 1024) -> dict[str, str]:
    """Session settings for a corpus of a given size.

    One shuffle block is written per pair of map task and reducer, so both are bounded:
    splits grow up to a gigabyte, and there are 200 to 50,000 shuffle partitions;
    adaptive execution joins those that turn out small.
    """
    split = min(1 << 30, max(partition_bytes, -(-input_bytes // 100_000)))
    partitions = min(50_000, max(200, -(-input_bytes // partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
    }
