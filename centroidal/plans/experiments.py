"""Repeated runs of the clustering job as rows of the trial table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from centroidal.operators.trials import TRIAL_SCHEMA
from centroidal.plans.clustering import ParallelModel, parallel_kmeans


def trial_frame(
    spark: SparkSession, model: ParallelModel, experiment_id: str, dataset_name: str, **settings: int | float
) -> DataFrame:
    """One finished run as a one-row trial table.

    ``settings`` are the options of the run: ``random_seed``, ``local_max_iterations``,
    ``global_max_iterations``, ``local_tolerance``, ``global_cost_tolerance`` and
    ``aggregation_restarts``.
    """
    if not experiment_id.strip() or not dataset_name.strip():
        raise ValueError("experiment and dataset need a name")
    for name in ("local_tolerance", "global_cost_tolerance"):
        if not math.isfinite(settings[name]):
            raise ValueError(f"{name} must be finite")
    values = {
        **settings,
        **model.seconds,
        "experiment_id": experiment_id,
        "dataset_name": dataset_name,
        "num_records": model.num_records,
        "num_features": len(model.centers[0]),
        "num_clusters": len(model.centers),
        "num_partitions": model.num_groups,
        "spark_master": spark.sparkContext.master,
        "materialized_record_count": sum(model.cluster_counts),
        "converged": model.converged,
        "iterations": model.iterations,
        "sse": model.sse,
        "cluster_counts": list(model.cluster_counts),
    }
    names = [entry.split(" ")[0] for entry in TRIAL_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(values[name] for name in names)], TRIAL_SCHEMA)


def run_trials(
    points: DataFrame,
    k: int,
    *,
    dataset_name: str,
    repetitions: int = 3,
    warmups: int = 0,
    random_seed: int = 42,
    n_buckets: int | None = None,
    local_max_iterations: int = 100,
    global_max_iterations: int = 100,
    local_tolerance: float = 1e-6,
    global_cost_tolerance: float = 1e-6,
    aggregation_restarts: int = 5,
    global_relative_tolerance: float = 0.0,
    tie_width: float = 0.0,
) -> DataFrame:
    """Trial rows of runs with seeds ``random_seed, random_seed + 1, ...``; warm-ups leave none.

    Cache ``points`` first (see ``materialized``), so that loading is not measured.
    """
    if repetitions <= 0 or warmups < 0:
        raise ValueError("repetitions must be positive and warm-ups not negative")
    settings = {
        "local_max_iterations": local_max_iterations,
        "global_max_iterations": global_max_iterations,
        "local_tolerance": local_tolerance,
        "global_cost_tolerance": global_cost_tolerance,
        "aggregation_restarts": aggregation_restarts,
    }
    # What the trial table has no column for.
    further = {"n_buckets": n_buckets, "global_relative_tolerance": global_relative_tolerance, "tie_width": tie_width}
    for _ in range(warmups):
        parallel_kmeans(points, k, random_seed=random_seed, **settings, **further).release()
    trials = None
    for repetition in range(repetitions):
        seed = random_seed + repetition
        model = parallel_kmeans(points, k, random_seed=seed, **settings, **further)
        model.release()
        experiment = f"{dataset_name}-n{model.num_records}-k{k}-r{repetition + 1}"
        row = trial_frame(points.sparkSession, model, experiment, dataset_name, random_seed=seed, **settings)
        trials = row if trials is None else trials.unionByName(row)
    return trials
