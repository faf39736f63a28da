"""The complete clustering jobs: three-stage k-means, best-of-seeds k-means, labelled runs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from time import perf_counter

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from centroidal.operators.assign import assign_models, centers_frame, predict, require_unique
from centroidal.operators.lloyd import LloydModel, check_loop_arguments, finish, iterate
from centroidal.operators.local import (
    SeededFit,
    aggregate_candidates,
    best_of,
    check_fit_arguments,
    collect_candidates,
    fit_seeds,
    partition_kmeans,
)
from centroidal.operators.packed import packed
from centroidal.operators.points import validate_points


@dataclass(frozen=True)
class ParallelModel:
    """Result of the three-stage job; ``local`` and ``candidates`` stay distributed."""

    centers: np.ndarray
    iterations: int
    converged: bool
    sse: float
    cluster_counts: tuple[int, ...]
    num_records: int
    num_groups: int
    unique_ids: bool | None  # True where the fit has seen that no id repeats, None where it cannot know
    local: DataFrame = field(repr=False)
    candidates: DataFrame = field(repr=False)
    candidate_count: int
    initialization: SeededFit = field(repr=False)
    refinement: LloydModel = field(repr=False)
    seconds: dict[str, float] = field(repr=False)

    def centers_frame(self, spark: SparkSession) -> DataFrame:
        return centers_frame(spark, self.centers)

    def release(self) -> None:
        """Drop the cached group results behind ``local`` and ``candidates``."""
        self.local.unpersist()


def parallel_kmeans(
    points: DataFrame,
    k: int,
    *,
    n_buckets: int | None = None,
    local_max_iterations: int = 100,
    global_max_iterations: int = 100,
    local_tolerance: float = 1e-6,
    global_cost_tolerance: float | None = 1e-6,
    global_relative_tolerance: float = 0.0,
    random_seed: int = 42,
    aggregation_restarts: int = 5,
    tie_width: float = 0.0,
) -> ParallelModel:
    """k-means seeded by independent k-means of bounded groups.

    1. k-means inside every group (partition, or hash bucket with ``n_buckets``);
    2. k-means of the pooled group centres from several seeds, lowest error kept;
    3. distributed Lloyd rounds until the error stops changing, then one
       measurement of the returned centres.

    See ``lloyd_fit`` for the two tolerances of stage 3.  ``points`` needs ``record_id`` and
    ``features``; no other column is read.  Its validity rules are enforced inside stage 1,
    which saves a separate scan.  ``points`` is read once by stage 1 and once by stage 3, whose
    rounds read cached blocks; the caller decides whether it is cached.
    """
    check_fit_arguments(k, local_max_iterations, local_tolerance)
    check_loop_arguments(global_max_iterations, global_cost_tolerance)
    if aggregation_restarts <= 0:
        raise ValueError("the number of restarts must be positive")
    points = points.select("record_id", "features")

    start = perf_counter()
    local = partition_kmeans(
        points,
        k,
        n_buckets=n_buckets,
        max_iterations=local_max_iterations,
        tolerance=local_tolerance,
        random_seed=random_seed,
    ).persist(StorageLevel.MEMORY_AND_DISK)  # k centres per group
    try:
        width = F.size(F.col("centers")[0])
        totals = local.agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum("record_count").alias("records"),
            F.sum("distinct_keys").alias("distinct"),
            F.min(width).alias("narrowest"),
            F.max(width).alias("widest"),
        ).first()
        if totals["groups"] == 0:
            raise ValueError("the point table must not be empty")
        if totals["narrowest"] != totals["widest"]:
            raise ValueError(f"groups have {totals['narrowest']} to {totals['widest']} features")
        pooled = perf_counter()

        candidates = collect_candidates(local)
        initialization = aggregate_candidates(
            candidates,
            k,
            rows=totals["groups"] * k,
            dimensions=totals["widest"],
            num_restarts=aggregation_restarts,
            max_iterations=local_max_iterations,
            tolerance=local_tolerance,
            random_seed=random_seed,
            tie_width=tie_width,
        )
        seeded = perf_counter()

        with packed(points, rows=totals["records"], dimensions=totals["widest"]) as blocks:
            history, converged = iterate(
                blocks, initialization.centers, global_max_iterations, global_cost_tolerance, global_relative_tolerance
            )
            refined = perf_counter()
            refinement = finish(blocks, history, converged)
            measured = perf_counter()
    except BaseException:
        local.unpersist()
        raise
    return ParallelModel(
        centers=refinement.centers,
        iterations=refinement.iterations,
        converged=refinement.converged,
        sse=refinement.sse,
        cluster_counts=refinement.cluster_counts,
        num_records=totals["records"],
        num_groups=totals["groups"],
        unique_ids=True if n_buckets is not None and totals["distinct"] == totals["records"] else None,
        local=local,
        candidates=candidates,
        candidate_count=totals["groups"] * k,
        initialization=initialization,
        refinement=refinement,
        seconds={
            "partition_clustering_seconds": pooled - start,
            "center_aggregation_seconds": seeded - pooled,
            "initialization_seconds": seeded - start,
            "global_clustering_seconds": refined - seeded,
            "final_evaluation_seconds": measured - refined,
            "total_runtime_seconds": measured - start,
        },
    )


@dataclass(frozen=True)
class MultiInitModel:
    """Best of several whole-table fits, with all of them for comparison."""

    best: SeededFit
    runs: tuple[SeededFit, ...] = field(repr=False)
    num_records: int
    num_features: int

    def runs_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f.seed, f.sse, f.iterations, f.converged, list(f.cluster_counts)) for i, f in enumerate(self.runs)]
        schema = "run int, seed bigint, sse double, iterations int, converged boolean, cluster_counts array<bigint>"
        return spark.createDataFrame(rows, schema)


def multi_init_kmeans(
    points: DataFrame,
    k: int,
    *,
    num_initializations: int = 1,
    max_iterations: int = 100,
    tolerance: float = 1e-6,
    random_seed: int = 42,
    tie_width: float = 0.0,
    distributed: bool | None = None,
) -> MultiInitModel:
    """Whole-table k-means from consecutive seeds; lowest error wins, the first of equals.

    See ``best_of`` for ``tie_width`` and ``fit_seeds`` for ``distributed``.
    """
    check_fit_arguments(k, max_iterations, tolerance)
    if num_initializations <= 0:
        raise ValueError("the number of initializations must be positive")
    summary = validate_points(points.select("features"))
    fits = fit_seeds(
        points,
        k,
        [random_seed + i for i in range(num_initializations)],
        rows=summary["rows"],
        dimensions=summary["features"],
        max_iterations=max_iterations,
        tolerance=tolerance,
        distributed=distributed,
    )
    return MultiInitModel(best_of(fits, tie_width), tuple(fits), summary["rows"], summary["features"])


@dataclass(frozen=True)
class LabeledRun:
    model: ParallelModel
    predictions: DataFrame = field(repr=False)
    sse: float
    cluster_counts: tuple[int, ...]


def _require_agreement(model: ParallelModel, rows: list[Row]) -> tuple[float, tuple[int, ...]]:
    """Error and sizes measured from assigned rows (at most k of them), which must be the model's."""
    k = len(model.centers)
    found = {row["cluster"]: row for row in rows}
    counts = tuple(found[c]["n"] if c in found else 0 for c in range(k))
    error = math.fsum(row["sse"] for row in rows)
    if sum(counts) != model.num_records or counts != model.cluster_counts:
        raise RuntimeError(f"independent sizes {counts} differ from {model.cluster_counts}")
    if not math.isclose(error, model.sse, rel_tol=1e-7, abs_tol=1e-6):
        raise RuntimeError(f"independent squared error {error} differs from {model.sse}")
    return error, counts


def labeled_run(points: DataFrame, k: int, *, label: str = "label", **options) -> LabeledRun:
    """Cluster without looking at labels, predict by record id, and check both agree.

    The predictions are measured from the assigned rows, independently of the
    fitting job; sizes must match exactly and squared errors to 1e-7 relative.  With
    ``n_buckets`` the fit brings equal ids together, so it also tells that none repeats, and
    no further exchange is needed for that.
    """
    model = parallel_kmeans(points.select("record_id", "features"), k, **options)
    known = bool(model.unique_ids)
    predictions = predict(points.select("record_id", "features", label), model.centers, unique_ids=known)
    measured = predictions.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("distance_sq").alias("sse")
    )
    error, counts = _require_agreement(model, measured.collect())
    return LabeledRun(model, predictions.drop("features"), error, counts)


@dataclass(frozen=True)
class RepeatedRuns:
    """One model per seed and the assignments of all of them, one row per record and repetition."""

    models: tuple[ParallelModel, ...]
    predictions: DataFrame = field(repr=False)

    def release(self) -> None:
        for model in self.models:
            model.release()


def labeled_repetitions(
    points: DataFrame,
    k: int,
    *,
    dataset_name: str,
    repetitions: int = 3,
    random_seed: int = 42,
    label: str = "label",
    **options,
) -> RepeatedRuns:
    """The labelled run once for each of ``repetitions`` consecutive seeds, as a prediction table.

    Every model is fitted without labels; all of them assign the records in one scan, and
    another one measures that sizes and errors are those of the fits.  The predictions are in
    the layout of ``write_predictions``: dataset, repetition from 1, seed, record id, true
    label, predicted cluster.
    """
    if repetitions <= 0:
        raise ValueError("the number of repetitions must be positive")
    features = points.select("record_id", "features")
    models = tuple(parallel_kmeans(features, k, random_seed=random_seed + r, **options) for r in range(repetitions))
    if not models[0].unique_ids:
        require_unique(points)
    assigned = assign_models(points.select("record_id", "features", label), np.stack([m.centers for m in models]))
    measured = (
        assigned.select(F.posexplode("assigned"))
        .groupBy("pos", F.col("col.cluster").alias("cluster"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("col.distance_sq").alias("sse"))
        .collect()  # at most k rows for each model
    )
    for run, model in enumerate(models):
        _require_agreement(model, [row for row in measured if row["pos"] == run])
    predictions = assigned.select("record_id", label, F.posexplode("assigned")).select(
        F.lit(dataset_name).alias("dataset_name"),
        (F.col("pos") + 1).alias("repetition"),
        (F.col("pos") + F.lit(random_seed).cast("bigint")).alias("random_seed"),
        "record_id",
        F.col(label).alias("true_label"),
        F.col("col.cluster").alias("predicted_cluster"),
    )
    return RepeatedRuns(models, predictions)
