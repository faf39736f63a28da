"""Assignment of points to fixed centres, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from centroidal.functions.kernels import nearest, to_matrix
from centroidal.functions.vectors import NOT_FINITE, UNROLL_LIMIT, is_finite, nearest_center, squared_euclidean
from centroidal.operators.points import validate_points

Centers = np.ndarray | Sequence[Sequence[float]] | DataFrame


def as_centers(centers: Centers) -> np.ndarray:
    """A (k, d) array from rows of floats or a ``(cluster, center)`` table of k rows."""
    if isinstance(centers, DataFrame):
        rows = sorted(centers.select("cluster", "center").collect(), key=lambda row: row["cluster"])
        if [row["cluster"] for row in rows] != list(range(len(rows))):
            raise ValueError("cluster ids must be 0..k-1, each once")
        centers = [row["center"] for row in rows]
    if len(centers) == 0:
        raise ValueError("at least one center is required")
    if len({len(center) for center in centers}) != 1 or len(centers[0]) == 0:
        raise ValueError("centers must have one common, positive number of features")
    array = np.array(centers, dtype=np.float64)
    if not np.isfinite(array).all():
        raise ValueError("centers must be finite")
    return array


def centers_frame(spark: SparkSession, centers: Centers) -> DataFrame:
    """``(cluster int, center array<double>)``."""
    rows = [(i, [float(v) for v in center]) for i, center in enumerate(as_centers(centers))]
    return spark.createDataFrame(rows, "cluster int, center array<double>")


def _finite(features: pa.Array) -> np.ndarray:
    block = to_matrix(features)
    if not np.isfinite(block).all():
        raise ValueError(NOT_FINITE)
    return block


def _best_by_arrow(centers: np.ndarray):
    @arrow_udf("struct<distance_sq:double,cluster:int>")
    def best(features: pa.Array) -> pa.Array:
        if len(features) == 0:
            labels, distances = np.empty(0, np.int64), np.empty(0)
        else:
            labels, distances = nearest(_finite(features), centers)
        return pa.StructArray.from_arrays(
            [pa.array(distances), pa.array(labels.astype(np.int32))], names=["distance_sq", "cluster"]
        )

    return best


def best_center(features: Column, centers: np.ndarray) -> Column:
    """``struct(distance_sq, cluster)``: compiled for small models, Arrow batches beyond."""
    if centers.size <= UNROLL_LIMIT:
        return nearest_center(features, centers.tolist())
    return _best_by_arrow(centers)(features)


def assign(points: DataFrame, centers: Centers) -> DataFrame:
    """Add ``cluster int, distance_sq double``; a stateless projection, no shuffle."""
    model = as_centers(centers)
    scored = points.withColumn("_best", best_center(F.col("features"), model))
    return scored.select(
        *[F.col(f"`{c}`") for c in points.columns],
        F.col("_best.cluster").alias("cluster"),
        F.col("_best.distance_sq").alias("distance_sq"),
    )


def assign_models(points: DataFrame, models: np.ndarray) -> DataFrame:
    """Add ``assigned``: for each of r models (r, k, d) a struct ``(distance_sq, cluster)``; one scan, no shuffle."""
    best = [best_center(F.col("features"), as_centers(model)) for model in models]
    return points.withColumn("assigned", F.array(*best))


def _gap_by_arrow(centers: np.ndarray):
    @arrow_udf("double")
    def gap(features: pa.Array, cluster: pa.Array) -> pa.Array:
        if len(features) == 0:
            return pa.array([], pa.float64())
        difference = _finite(features) - centers[cluster.to_numpy(zero_copy_only=False)]
        return pa.array(np.einsum("ij,ij->i", difference, difference))

    return gap


def sse(points: DataFrame, centers: Centers, cluster: str = "cluster") -> DataFrame:
    """One row ``sse``: squared error of points that already carry a cluster id.

    A null or out-of-range cluster id is an error.
    """
    model = as_centers(centers)
    index = F.col(cluster).cast("int")
    invalid = F.raise_error(F.lit("cluster id is missing or out of range")).cast("int")
    valid = F.when(F.coalesce((index >= 0) & (index < len(model)), F.lit(False)), index).otherwise(invalid)
    if model.size <= UNROLL_LIMIT:
        lookup = F.array(*[F.array(*[F.lit(float(v)) for v in center]) for center in model])
        finite = F.forall("features", is_finite)
        error = F.when(finite, squared_euclidean(F.col("features"), F.get(lookup, valid))).otherwise(
            F.raise_error(F.lit(NOT_FINITE)).cast("double")
        )
    else:
        error = _gap_by_arrow(model)(F.col("features"), valid)
    return points.agg(F.coalesce(F.sum(error), F.lit(0.0)).alias("sse"))


def evaluate_centers(points: DataFrame, centers: Centers) -> DataFrame:
    """``(cluster int, n bigint, sse double)`` for fixed centres; absent clusters count 0."""
    model = as_centers(centers)
    found = (
        points.select(best_center(F.col("features"), model).alias("best"))
        .groupBy(F.col("best.cluster").alias("cluster"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("best.distance_sq").alias("sse"))
    )
    every = points.sparkSession.range(len(model)).select(F.col("id").cast("int").alias("cluster"))
    return every.join(found, "cluster", "left").select(
        "cluster",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce("sse", F.lit(0.0)).alias("sse"),
    )


def cluster_sizes(points: DataFrame, centers: Centers) -> DataFrame:
    """``(cluster int, n bigint)`` including empty clusters."""
    return evaluate_centers(points, centers).select("cluster", "n")


def require_unique(points: DataFrame, record_id: str = "record_id") -> None:
    """Raise ValueError for a record id that occurs twice; one exchange of the ids."""
    repeated = points.groupBy(record_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    if repeated:
        raise ValueError(f"record id {repeated[0][0]} occurs {repeated[0]['n']} times")


def predict(
    points: DataFrame,
    centers: Centers,
    *,
    record_id: str = "record_id",
    check: bool = True,
    unique_ids: bool = False,
) -> DataFrame:
    """Assignments keyed by record id; ids, labels and other columns travel with the row.

    ``check`` verifies, with two aggregates, that points are valid and match the
    centres, that ``k <= n`` and that record ids are unique.  ``unique_ids`` says that the
    latter is known already, which saves an exchange of all ids.
    """
    model = as_centers(centers)
    if check:
        summary = validate_points(points, expected_features=model.shape[1])
        if len(model) > summary["rows"]:
            raise ValueError(f"{len(model)} clusters exceed {summary['rows']} records")
        if not unique_ids:
            require_unique(points, record_id)
    return assign(points, model)
