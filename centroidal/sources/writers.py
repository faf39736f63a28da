"""Writers: every table goes from the executors to storage, never through the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.functions.vectors import unpack
from centroidal.operators.layout import written
from centroidal.operators.points import exact_sample, validate_points
from centroidal.operators.trials import TRIAL_SCHEMA
from centroidal.sources.readers import is_absent, read_trials

PREDICTION_COLUMNS = ("dataset_name", "repetition", "random_seed", "record_id", "true_label", "predicted_cluster")


def save_dataset(points: DataFrame, name: str, directory: str, dimensions: int, *, label: str = "label") -> str:
    """Wide ``f0..f{d-1}, label`` parquet; replaces an earlier dataset of that name."""
    path = f"{directory}/{name}.parquet"
    wide = points.select(*unpack(F.col("features"), dimensions), F.col(label).cast("bigint").alias("label"))
    wide.write.mode("overwrite").parquet(path)
    return path


def split_features_labels(points: DataFrame, directory: str, name: str, k: int) -> tuple[str, str]:
    """Features without labels, and labels by record id; existing output is an error.

    Both tables keep ``record_id``, so they can be joined again whatever their order.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = validate_points(points, name=name)["rows"]
    if k > rows:
        raise ValueError(f"k={k} exceeds {rows} records")
    features, labels = f"{directory}/{name}_features.parquet", f"{directory}/{name}_labels.parquet"
    points.select("record_id", "features").write.mode("errorifexists").parquet(features)
    points.select("record_id", "label").write.mode("errorifexists").parquet(labels)
    return features, labels


def write_points_csv(points: DataFrame, path: str, dimensions: int) -> str:
    """Header-less comma-separated features; existing output is an error."""
    points.select(*unpack(F.col("features"), dimensions)).write.mode("errorifexists").csv(path)
    return path


def append_trial(trials: DataFrame, path: str, format: str = "parquet") -> str:
    """Append trial records; CSV holds one header per file and counts as ``a;b;c``."""
    fields = dict(entry.split(" ") for entry in TRIAL_SCHEMA.split(", "))
    typed = trials.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields.items()])
    if format == "csv":
        typed = typed.withColumn("cluster_counts", F.concat_ws(";", F.col("cluster_counts").cast("array<string>")))
        typed.write.mode("append").option("header", True).csv(path)
    else:
        typed.write.mode("append").parquet(path)
    return path


def append_trials_once(trials: DataFrame, path: str, format: str = "parquet") -> int:
    """Append the trials whose ``experiment_id`` the table does not have yet; returns how many.

    The measurements are staged in the shared folder first, so they are made once; then the
    ids that are there already are left out.  Files appear in the table whole, so a job that is
    run again, also after it was lost half-way through its commit, adds what is missing and
    nothing twice.  Ids must be unique and not null.  Two jobs with the same ids must not
    run at the same time.
    """
    spark = trials.sparkSession
    staged = written(trials.select(*[entry.split(" ")[0] for entry in TRIAL_SCHEMA.split(", ")]), "trials")
    ids = staged.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("rows"))
    bad = ids.where("experiment_id IS NULL OR rows > 1").orderBy("experiment_id").take(1)
    if bad:
        raise ValueError(f"experiment ids must be unique and not null; {bad[0][0]} has {bad[0][1]} rows")
    fresh = staged
    try:
        known = read_trials(spark, path, format).select("experiment_id")
        fresh = written(staged.join(known, "experiment_id", "left_anti"), "trials")
    except AnalysisException as absent:
        if not is_absent(absent):
            raise
    added = fresh.count()
    if added:
        append_trial(fresh, path, format)
    return added


def predictions_table(runs: Mapping[tuple[int, int], DataFrame], dataset_name: str, *, label: str = "label") -> DataFrame:
    """Union of assigned tables keyed by ``(repetition, random_seed)`` in the prediction layout."""
    parts = [
        assigned.select(
            F.lit(dataset_name).alias("dataset_name"),
            F.lit(repetition).alias("repetition"),
            F.lit(seed).cast("bigint").alias("random_seed"),
            "record_id",
            F.col(label).alias("true_label"),
            F.col("cluster").alias("predicted_cluster"),
        )
        for (repetition, seed), assigned in runs.items()
    ]
    if not parts:
        raise ValueError("at least one run is required")
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def write_predictions(predictions: DataFrame, path: str, *, records: int, repetitions: int, format: str = "parquet") -> str:
    """Write exactly ``records * repetitions`` prediction rows; existing output is an error."""
    rows = predictions.count()
    if rows != records * repetitions:
        raise ValueError(f"expected {records * repetitions} predictions, got {rows}")
    writer = predictions.select(*PREDICTION_COLUMNS).write.mode("errorifexists")
    (writer.option("header", True).csv if format == "csv" else writer.parquet)(path)
    return path


def write_sample(
    points: DataFrame, path: str, dimensions: int, n: int = 1000, seed: int = 42, *, record_id: str = "record_id"
) -> str:
    """CSV with header of an exact sample, features with 5 decimals."""
    sample = exact_sample(points, n, seed, record_id=record_id)  # a filter: file order is kept
    columns = [F.format_string("%.5f", F.col("features")[i]).alias(f"f{i}") for i in range(dimensions)]
    sample.select(*columns, "label").write.mode("errorifexists").option("header", True).csv(path)
    return path
