"""Points as packed blocks, for jobs that read the same rows many times.

A block is the float64 features of many rows in one binary value, with their keys in another
where seeding needs them.  A scan copies such values from the cache to the workers as they
are; of plain points it converts every number, and hashes every record id, each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.functions.kernels import to_matrix
from centroidal.functions.keys import row_key

BLOCK_BYTES = 1 << 20
PARTITION_BYTES = 64 << 20  # of blocks, in a partition that is put together from small ones
_BLOCKS = "width int, block binary"


def is_packed(points: DataFrame) -> bool:
    return "block" in points.columns and "features" not in points.columns


def keyed(points: DataFrame) -> DataFrame:
    """``(key, features)``: what seeding needs of a point table; packed points stay as they are."""
    if is_packed(points):
        return points
    key = F.col("key") if "key" in points.columns else row_key(F.col("record_id"))
    return points.select(key.alias("key"), "features")


def features_of(points: DataFrame) -> DataFrame:
    return points.select("width", "block") if is_packed(points) else points.select("features")


def pack(points: DataFrame) -> DataFrame:
    """``(width, block[, keys])``: the rows of ``(features[, key])`` in blocks, as they lie."""
    with_keys = "key" in points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = to_matrix(batch.column("features"))
            keys = batch.column("key").to_numpy(zero_copy_only=False) if with_keys else None
            step = max(1, BLOCK_BYTES // (8 * matrix.shape[1]))
            for start in range(0, len(matrix), step):
                part = slice(start, start + step)
                columns = {
                    "width": pa.array([matrix.shape[1]], pa.int32()),
                    "block": pa.array([matrix[part].tobytes()], pa.binary()),
                }
                if with_keys:
                    columns["keys"] = pa.array([keys[part].astype(np.int64).tobytes()], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return points.mapInArrow(run, f"{_BLOCKS}, keys binary" if with_keys else _BLOCKS)


def matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The features of a batch of plain or packed points."""
    if "block" not in batch.schema.names:
        if batch.num_rows:
            yield to_matrix(batch.column("features"))
        return
    for width, block in zip(batch.column("width").to_pylist(), batch.column("block")):
        # A copy, as how a buffer is aligned in its batch would show in the last bits of sums.
        yield np.frombuffer(block.as_buffer(), np.float64).reshape(-1, width).copy()


def keyed_matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and features of a batch of plain or packed keyed points."""
    if "block" not in batch.schema.names:
        if batch.num_rows:
            yield batch.column("key").to_numpy(zero_copy_only=False), to_matrix(batch.column("features"))
        return
    for keys, matrix in zip(batch.column("keys"), matrices(batch)):
        yield np.frombuffer(keys.as_buffer(), np.int64), matrix


@contextmanager
def packed(
    points: DataFrame, *, with_keys: bool = False, rows: int | None = None, dimensions: int | None = None
) -> Iterator[DataFrame]:
    """The points in blocks that are cached for the duration of a ``with`` statement.

    With the numbers of rows and features, many small partitions become fewer, of at least
    PARTITION_BYTES where that leaves some for each core, without a shuffle.
    """
    chosen = keyed(points) if with_keys else points.select("features")
    if rows is not None and dimensions is not None:
        cores = points.sparkSession.sparkContext.defaultParallelism
        wanted = max(4 * cores, -(-rows * dimensions * 8 // PARTITION_BYTES))
        if chosen.rdd.getNumPartitions() > 2 * wanted:
            chosen = chosen.coalesce(wanted)
    blocks = pack(chosen).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield blocks
    finally:
        blocks.unpersist()
