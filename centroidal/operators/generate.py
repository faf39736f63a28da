"""Blob tables generated by Spark: every row is a function of its id and the seed."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from centroidal.functions.keys import row_key, uniform, uniform_array
from centroidal.operators.assign import as_centers, centers_frame
from centroidal.operators.prepare import nested_prefixes

# --- fixed values: the size ladder of the scaling experiments, and the blob defaults ---
SIZE_LADDER = (1_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 2_500_000, 5_000_000)
CENTER_BOX = (-10.0, 10.0)
# ----------------------------------------------------------------------------------------


def _quotient(dividend: Column, divisor: int) -> Column:
    """Integer quotient of a non-negative bigint; the division has no remainder left to round."""
    return ((dividend - F.pmod(dividend, F.lit(divisor).cast("bigint"))) / divisor).cast("bigint")


def balanced_label(position: Column, rows: int, k: int) -> Column:
    """Cluster of a 0-based position when rows are cluster-ordered and sizes differ by at most 1.

    The remainder of ``rows / k`` goes to the lowest cluster ids.
    """
    small, remainder = divmod(rows, k)
    edge = remainder * (small + 1)
    in_large = _quotient(position, small + 1)
    in_small = _quotient(position - edge, max(small, 1)) + remainder
    return F.when(position < edge, in_large).otherwise(in_small).cast("int")


def mixed_label(position: Column, k: int, seed: int) -> Column:
    """Cluster of a position such that every block of k rows holds each cluster once.

    Any prefix of the table is then balanced, so prefixes can serve as smaller tables.
    """
    block = _quotient(position, k)
    turn = F.floor(uniform(row_key(block), seed, 0) * k)
    return F.pmod(position + turn, F.lit(k)).cast("int")


def diagonal_centers(k: int, dimensions: int, separation: float = 10.0) -> np.ndarray:
    """``center[j][i] = j * separation + i``."""
    return np.arange(k)[:, None] * separation + np.arange(dimensions)[None, :]


def uniform_centers(k: int, dimensions: int, seed: int = 42) -> np.ndarray:
    """Centres uniform in the standard box, fixed by the seed."""
    return np.random.default_rng(seed).uniform(*CENTER_BOX, size=(k, dimensions))


def check_blob_arguments(rows: int, dimensions: int, k: int, spread: float, separation: float = 1.0) -> None:
    if min(rows, dimensions, k) <= 0:
        raise ValueError("rows, features and clusters must be positive")
    if k > rows:
        raise ValueError("clusters cannot exceed rows")
    if not (math.isfinite(spread) and spread >= 0):
        raise ValueError("the spread must be finite and not negative")
    if not (math.isfinite(separation) and separation > 0):
        raise ValueError("the separation must be finite and positive")


def _coordinates(centers: np.ndarray, spread: float, seed: int):
    dimensions = centers.shape[1]

    @arrow_udf("array<double>")
    def place(key: pa.Array, label: pa.Array) -> pa.Array:
        keys = key.to_numpy(zero_copy_only=False)
        values = centers[label.to_numpy(zero_copy_only=False)]
        for pair in range((dimensions + 1) // 2 if spread else 0):  # Box-Muller gives two at a time
            radius = spread * np.sqrt(-2.0 * np.log(uniform_array(keys, seed, 2 * pair + 1)))
            angle = 2.0 * np.pi * uniform_array(keys, seed, 2 * pair + 2)
            values[:, 2 * pair] += radius * np.cos(angle)
            if 2 * pair + 1 < dimensions:
                values[:, 2 * pair + 1] += radius * np.sin(angle)
        offsets = np.arange(0, values.size + 1, dimensions, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))

    return place


def blobs_from_ids(
    ids: DataFrame, label: Column, centers: Sequence[Sequence[float]] | np.ndarray, spread: float, seed: int
) -> DataFrame:
    """``(record_id, features, label)`` for a table of record ids.

    Noise is a function of the seed and the record id, so the table is the same
    however it is partitioned, chunked or retried.  It is drawn for whole Arrow
    batches: as a column expression it would outgrow the JIT.
    """
    placed = ids.select("record_id", label.alias("label"), row_key(F.col("record_id")).alias("key"))
    place = _coordinates(as_centers(centers), float(spread), seed)
    return placed.select("record_id", place("key", "label").alias("features"), "label")


def diagonal_blobs(
    spark: SparkSession,
    rows: int,
    dimensions: int,
    k: int,
    *,
    spread: float = 1.0,
    separation: float = 10.0,
    seed: int = 42,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cluster-ordered blobs around diagonal centres, and the centres."""
    check_blob_arguments(rows, dimensions, k, spread, separation)
    centers = diagonal_centers(k, dimensions, separation)
    ids = spark.range(0, rows, 1, partitions).select(F.col("id").alias("record_id"))
    points = blobs_from_ids(ids, balanced_label(F.col("record_id"), rows, k), centers, spread, seed)
    return points, centers_frame(spark, centers)


def uniform_blobs(
    spark: SparkSession,
    rows: int,
    dimensions: int = 20,
    k: int = 5,
    *,
    spread: float = 1.0,
    seed: int = 42,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Blobs around uniform centres whose every prefix is class-balanced, and the centres."""
    check_blob_arguments(rows, dimensions, k, spread)
    centers = uniform_centers(k, dimensions, seed)
    ids = spark.range(0, rows, 1, partitions).select(F.col("id").alias("record_id"))
    points = blobs_from_ids(ids, mixed_label(F.col("record_id"), k, seed), centers, spread, seed)
    return points, centers_frame(spark, centers)


def size_ladder(
    spark: SparkSession, sizes: Sequence[int] = SIZE_LADDER, dimensions: int = 20, k: int = 5, *, seed: int = 42
) -> DataFrame:
    """Nested, separately scaled tables of growing size from one generated table."""
    points, _ = uniform_blobs(spark, max(sizes), dimensions, k, seed=seed)
    names = [f"f{i}" for i in range(dimensions)]
    wide = points.select("record_id", *[F.col("features")[i].alias(n) for i, n in enumerate(names)], "label")
    return nested_prefixes(wide, sizes, names)
