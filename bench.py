"""Benchmark: headline queries over the test tables, and the published clustering workloads.

Prints one JSON line.  ``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the
number of local cores.  Published workloads follow the published protocol: generation
and caching are not timed and one warm-up run precedes the measured one.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from pathlib import Path
from time import perf_counter

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from centroidal.deploy import ship  # noqa: E402
from centroidal.operators.generate import diagonal_blobs  # noqa: E402
from centroidal.operators.layout import materialized  # noqa: E402
from centroidal.plans.clustering import multi_init_kmeans, parallel_kmeans  # noqa: E402
from checks import queries as registered  # noqa: E402

HEADLINE = (
    registered.parallel_kmeans,
    registered.parallel_kmeans_partitions,
    registered.labeled_run,
    registered.lloyd_fit,
    registered.lloyd_step,
    registered.bucket_local_kmeans,
    registered.multi_init_kmeans,
    registered.kmeanspp_seeds,
    registered.assign_lines,
    registered.evaluate_centers,
    registered.quality_row,
    registered.standardize,
    registered.ordinal_encode,
    registered.prepare_orders,
    registered.nested_prefixes,
    registered.exact_sample,
    registered.record_ids,
    registered.points_csv_round_trip,
    registered.trial_summary,
    registered.quality_comparison,
    registered.diagonal_blobs,
)
# rows, groups: the published sizes, 20 features and 5 clusters each
PUBLISHED = {"blobs_10k": (10_000, 4), "blobs_50k": (50_000, 4), "blobs_1m": (1_000_000, 16)}
ORDERED_PARTITIONS = 4  # the published layout: slices in the order of the clusters, not dealt out


def timed(action: Callable[[], object]) -> float:
    start = perf_counter()
    action()
    return round(perf_counter() - start, 3)


def headline(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    seconds = {}
    for query in HEADLINE:
        seconds[query.__name__] = timed(
            lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        )
    return seconds


def published(spark: SparkSession) -> tuple[dict[str, float], dict[str, float]]:
    seconds, errors = {}, {}
    for name, (rows, groups) in PUBLISHED.items():
        blobs, _ = diagonal_blobs(spark, rows, 20, 5, partitions=groups)
        ordered, _ = diagonal_blobs(spark, rows, 20, 5, partitions=ORDERED_PARTITIONS)
        with materialized(ordered.select("record_id", "features"), rows) as (slices, _):
            parallel_kmeans(slices, 5).release()
            seconds[f"{name}_ordered_4"] = timed(lambda: parallel_kmeans(slices, 5).release())
        # Cluster-ordered rows are dealt out first, so that each group sees every cluster.
        with materialized(blobs.select("record_id", "features").repartition(groups), rows) as (points, _):

            def fit(**options):
                model = parallel_kmeans(points, 5, **options)
                errors[name] = round(model.sse, 3)
                model.release()

            fit()
            seconds[f"{name}_partitions"] = timed(fit)
            seconds[f"{name}_buckets"] = timed(lambda: fit(n_buckets=groups))
            if rows <= 10_000:
                seconds[f"{name}_multi_init_5"] = timed(lambda: multi_init_kmeans(points, 5, num_initializations=5))
    return seconds, errors


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("centroidal-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    registered.lloyd_step(spark, sf_dir).collect()  # start the workers
    seconds = headline(spark, sf_dir)
    workloads, errors = published(spark)
    seconds |= workloads
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sse": errors,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
