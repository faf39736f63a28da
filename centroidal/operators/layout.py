"""Partition layout, caching and scratch storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centroidal.functions.keys import hash_bucket

# Most rows of a narrow lookup table (an id and a few numbers or one text) to broadcast.
BROADCAST_ROWS = 200_000


def count_partition_records(df: DataFrame) -> DataFrame:
    """``(partition int, records bigint)``; empty partitions are listed with 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = sum(batch.num_rows for batch in batches)
        partition = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {"partition": pa.array([partition], pa.int32()), "records": pa.array([records], pa.int64())}
        )

    return df.select(F.lit(True).alias("row")).mapInArrow(count, "partition int, records bigint")


def exact_partitions(df: DataFrame, n: int) -> DataFrame:
    """Exactly n partitions: merged without a shuffle when there are more, shuffled when fewer."""
    if n <= 0:
        raise ValueError("the number of partitions must be positive")
    current = df.rdd.getNumPartitions()
    if current > n:
        return df.coalesce(n)
    return df.repartition(n) if current < n else df


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side of known row count, withheld above the bound.

    Without the hint Spark picks the join from the size it sees at run time.
    """
    return F.broadcast(df) if rows <= most else df


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core; a table with more than that is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return exact_partitions(df, max(cores, df.rdd.getNumPartitions()))


@contextmanager
def materialized(df: DataFrame, expected_rows: int | None = None) -> Iterator[tuple[DataFrame, int]]:
    """Cache and count ``df`` for the duration of a block; always released, also on failure."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = cached.count()
        if expected_rows is not None and rows != expected_rows:
            raise ValueError(f"expected {expected_rows} rows, materialized {rows}")
        yield cached, rows
    finally:
        cached.unpersist()


def with_bucket(df: DataFrame, n_buckets: int, record_id: str = "record_id") -> DataFrame:
    """Add ``bucket int``: a reproducible stand-in for a physical partition."""
    if n_buckets <= 0:
        raise ValueError("the number of buckets must be positive")
    return df.withColumn("bucket", hash_bucket(F.col(record_id), n_buckets))


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="centroidal-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``.  Where none is named, a
    local session gets a temporary folder and a cluster gets an error, because a
    machine-local folder is not visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_scratch()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
