"""The test tables seen as points, categories and measurements."""

from __future__ import annotations

from contextlib import AbstractContextManager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centroidal.functions.keys import salted_key
from centroidal.functions.vectors import pack
from centroidal.operators.layout import materialized, spread
from centroidal.operators.prepare import standardize

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Clean names of the order priorities and the class each belongs to.
PRIORITY_CLASS = {
    "1-URGENT": "fast",
    "2-HIGH": "fast",
    "3-MEDIUM": "normal",
    "4-NOT SPECIFIED": "none",
    "5-LOW": "slow",
}
CLASS_NAMES = ("fast", "normal", "slow")
DROPPED_CLASS = "none"
# Attack names the priorities stand for where orders act as connection records.
ATTACK_OF_PRIORITY = {
    "1-URGENT": "smurf",
    "2-HIGH": "normal",
    "3-MEDIUM": "satan",
    "4-NOT SPECIFIED": "rootkit",
    "5-LOW": "guess_passwd",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 features per vector, labelled."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("record_id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under a text key, which is the only unique one the table has."""
    key = F.concat_ws(
        "-",
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.round(F.col("l_extendedprice") * 100).cast("bigint"),
    )
    return table(spark, sf_dir, "lineitem").select(
        key.alias("record_id"), *MEASURES, F.col("l_returnflag").alias("label")
    )


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scaled features per order line, labelled by the return flag."""
    scaled = standardize(raw_lines(spark, sf_dir), MEASURES)
    return scaled.select("record_id", pack(*MEASURES).alias("features"), "label")


def cached_lines(spark: SparkSession, sf_dir: str) -> AbstractContextManager[tuple[DataFrame, int]]:
    """The order lines as cached points for jobs that read them many times, and their number."""
    return materialized(spread(line_points(spark, sf_dir)))


def counted_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The order lines as points for jobs that read them a few times and keep what they need, and their number."""
    return spread(line_points(spark, sf_dir)), table(spark, sf_dir, "lineitem").count()


def starting_centers(points: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    """The k rows of smallest salted hash, in id order: a start that no label influences.

    One scan: every task keeps its best k rows.
    """
    hashed = points.select("record_id", "features", salted_key(F.col("record_id"), seed).alias("hash"))
    rows = hashed.orderBy("hash", "record_id").limit(k).collect()
    return np.array([row["features"] for row in sorted(rows, key=lambda row: row["record_id"])])


def noisy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority is written the careless way raw labels are."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.concat(F.lit("  "), "o_orderpriority", F.lit("..")).alias("label"),
        "o_orderstatus",
        "o_totalprice",
        F.year("o_orderdate").cast("double").alias("year"),
        F.lit(7.5).alias("constant"),
    )


def event_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as repeated measurements: the type is the configuration, the hour the size."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("configuration"),
        F.hour("ts").alias("size"),
        F.col("user_id").alias("iterations"),
        (F.col("value") * F.col("value")).alias("sse"),
        F.col("value").alias("total_runtime_seconds"),
        (F.col("value") < 100).alias("converged"),
    )


def order_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quality measurements: priority is the dataset, status the kind of run."""
    status = F.col("o_orderstatus")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("dataset"), status)
        .agg(
            (F.avg("o_totalprice") / 1000).alias("elapsed_seconds"),
            (F.avg("o_totalprice") / 1000000).alias("purity"),
            (F.min("o_totalprice") / 1000000).alias("ari"),
            (F.max("o_totalprice") / 1000000).alias("nmi"),
        )
        .select(
            "dataset",
            F.when(status == "P", "traditional_kmeans").otherwise("parallel_kmeans").alias("algorithm"),
            F.when(status == "F", "local[2]").otherwise("local[1]").alias("master"),
            "elapsed_seconds",
            "purity",
            "ari",
            "nmi",
        )
    )
