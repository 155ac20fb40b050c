"""Corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table.

    The setting ``kurzwerk.read.tasks`` spreads it over so many tasks, for a benchmark
    on a small table that lies in one row group; it is unset otherwise.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    tasks = spark.conf.get("kurzwerk.read.tasks", None)
    return df.repartition(int(tasks)) if tasks else df


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in key order, null keys first.

    A distributed top-n over the keys alone, then a semi-join, so that the rows
    themselves never meet in one task. Of rows that share the last key only as many as
    are left to take do, in the order of a hash of their columns.
    """
    first = df.select(F.col(key).alias("_key")).orderBy("_key").limit(n)
    end = first.groupBy("_key").agg(F.count("*").alias("n")).orderBy(F.desc("_key")).first()
    if end is None:
        return df.limit(0)
    last = F.lit(end["_key"])
    tied = df.filter(F.col(key).eqNullSafe(last)).orderBy(F.xxhash64(*df.columns)).limit(end["n"])
    keys = first.filter(~F.col("_key").eqNullSafe(last)).distinct()
    before = df.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return before.unionAll(tied)
