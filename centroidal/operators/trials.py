"""Analytics over repeated trials: summaries, speed-up and quality comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: the column names of the trial and quality tables -------------------
TRIAL_SCHEMA = (
    "experiment_id string, dataset_name string, num_records bigint, num_features int, num_clusters int,"
    " num_partitions int, spark_master string, random_seed bigint, local_max_iterations int,"
    " global_max_iterations int, local_tolerance double, global_cost_tolerance double,"
    " aggregation_restarts int, materialized_record_count bigint, converged boolean, iterations int,"
    " sse double, cluster_counts array<bigint>, partition_clustering_seconds double,"
    " center_aggregation_seconds double, initialization_seconds double, global_clustering_seconds double,"
    " final_evaluation_seconds double, total_runtime_seconds double"
)
QUALITY_SCHEMA = (
    "dataset string, algorithm string, master string, records bigint, features int, clusters int, sse double,"
    " purity double, ari double, nmi double, cluster_counts array<bigint>, elapsed_seconds double,"
    " iterations int, converged boolean"
)
MEASURES = (
    "iterations",
    "sse",
    "partition_clustering_seconds",
    "center_aggregation_seconds",
    "initialization_seconds",
    "global_clustering_seconds",
    "final_evaluation_seconds",
    "total_runtime_seconds",
)
PARALLEL, BASELINE, BASE_MASTER = "parallel_kmeans", "traditional_kmeans", "local[1]"
# ---------------------------------------------------------------------------------------


def convergence_rate(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of converged runs per configuration."""
    return trials.groupBy(*by).agg(F.avg(F.col("converged").cast("int")).alias("convergence_rate"))


def summarize_trials(trials: DataFrame, by: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Repetitions, convergence, and mean and sample deviation of every measure.

    The deviation of a single run is 0.
    """
    aggregates = [
        F.count(F.lit(1)).alias("repetitions"),
        F.count_if("converged").alias("converged_runs"),
        F.avg(F.col("converged").cast("int")).alias("convergence_rate"),
    ]
    for measure in measures:
        value = F.col(measure).cast("double")
        aggregates += [
            F.avg(value).alias(f"mean_{measure}"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"std_{measure}"),
        ]
    return trials.groupBy(*by).agg(*aggregates)


def speedup(
    summary: DataFrame, *, size: str, configuration: str, base: str, seconds: str = "mean_total_runtime_seconds"
) -> DataFrame:
    """Add speed-up and runtime reduction against the base configuration of equal size.

    ``summary`` has one row per size and configuration, so the window over a size
    holds as many rows as there are configurations, and the trials are read once.
    Times that are not positive give null.
    """
    same_size = Window.partitionBy(size)
    base_time = F.max(F.when(F.col(configuration) == base, F.col(seconds))).over(same_size)
    positive = F.when(F.col(seconds) > 0, F.col(seconds))
    base_positive = F.when(F.col("base_seconds") > 0, F.col("base_seconds"))
    return (
        summary.withColumn("base_seconds", base_time)
        .withColumn("speedup", F.try_divide(base_positive, positive))
        .withColumn("runtime_reduction_percent", (1.0 - F.try_divide(positive, base_positive)) * 100.0)
        .drop("base_seconds")
    )


def _demand(holds: Column, message: Column, value: Column) -> Column:
    return F.when(holds, value).otherwise(F.raise_error(message).cast("string"))


def quality_comparison(quality: DataFrame) -> DataFrame:
    """Per dataset: parallel base run against the baseline run, with speed-up and gaps.

    Exactly one parallel run on the base master and one baseline run are required,
    and at most one parallel run on another master; otherwise the query fails.
    One aggregation by dataset, no join.
    """
    parallel = F.col("algorithm") == PARALLEL
    roles = {
        "base": parallel & (F.col("master") == BASE_MASTER),
        "other": parallel & (F.col("master") != BASE_MASTER),
        "baseline": F.col("algorithm") == BASELINE,
    }
    row = F.struct("master", "elapsed_seconds", "purity", "ari", "nmi")
    grouped = quality.groupBy("dataset").agg(
        *[F.count_if(is_role).alias(f"{role}_runs") for role, is_role in roles.items()],
        *[F.max(F.when(is_role, row)).alias(role) for role, is_role in roles.items()],
    )
    complete = (F.col("base_runs") == 1) & (F.col("baseline_runs") == 1) & (F.col("other_runs") <= 1)
    problem = F.concat(
        F.lit("dataset "), F.col("dataset"),
        F.lit(" needs one base, one baseline and at most one other parallel run; found "),
        F.concat_ws(", ", "base_runs", "baseline_runs", "other_runs"),
    )
    other_seconds = F.when(F.col("other.elapsed_seconds") > 0, F.col("other.elapsed_seconds"))
    gaps = [(F.col(f"base.{m}") - F.col(f"baseline.{m}")).alias(f"{m}_gap") for m in ("purity", "ari", "nmi")]
    return grouped.select(
        _demand(complete, problem, F.col("dataset")).alias("dataset"),
        F.col("base.master").alias("base_master"),
        F.col("base.elapsed_seconds").alias("base_seconds"),
        F.col("other.master").alias("comparison_master"),
        F.col("other.elapsed_seconds").alias("comparison_seconds"),
        F.try_divide(F.col("base.elapsed_seconds"), other_seconds).alias("speedup"),
        *[F.col(f"base.{m}").alias(f"parallel_{m}") for m in ("purity", "ari", "nmi")],
        F.col("baseline.elapsed_seconds").alias("baseline_seconds"),
        *[F.col(f"baseline.{m}").alias(f"baseline_{m}") for m in ("purity", "ari", "nmi")],
        *gaps,
    )
