"""One Spark query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centroidal.functions.keys import row_key, uniform
from centroidal.functions.vectors import nearest_center, pack, squared_euclidean, unpack
from centroidal.operators import assign as assigning
from centroidal.operators import generate, lloyd, local, points, prepare, quality, seeding, trials
from centroidal.operators.layout import count_partition_records, materialized, scratch_path, with_bucket
from centroidal.operators.layout import exact_partitions as exactly
from centroidal.plans import clustering
from centroidal.plans.experiments import run_trials
from centroidal.plans.preparation import prepare_kdd, prepare_table
from centroidal.sources import kdd, readers, writers
from checks.tables import (
    ATTACK_OF_PRIORITY,
    CLASS_NAMES,
    DROPPED_CLASS,
    MEASURES,
    PRIORITY_CLASS,
    cached_lines,
    counted_lines,
    embedding_points,
    event_trials,
    line_points,
    noisy_orders,
    order_measurements,
    raw_lines,
    starting_centers,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]

LINE_K = 5
EMBEDDING_K = 10
LOCAL_ROUNDS = 100  # group and pool fits; all settle before
SETTLED = 1e-4  # relative change of the error at which distributed refinement ends, well below its 100 rounds
CENTERS_REST = 1e-3  # squared movement of a centre at which distributed fits from several seeds end
RESTARTS = 5
OVERSAMPLING_ROUNDS = 3
TIE_WIDTH = 1e-12  # errors of restarts that differ only by the order of summation
ROWS_PER_BUCKET = 20_000
FAR_AWAY = [1e6, 1e6, 1e6, 1e6]
SAMPLE_ROWS = 1000
PREFIX_PARTS = (10, 4, 2, 1)  # sizes of nested prefixes, as divisors of the row count


def _r(column, digits: int = 6):
    # Adding zero turns -0.0 into 0.0.
    return F.round(column, digits) + F.lit(0.0)


def _coordinates(column: str, dimensions: int):
    return [_r(F.col(column)[i]).alias(f"c{i}") for i in range(dimensions)]


def _long(df: DataFrame, *keys: str, vector: str = "center") -> DataFrame:
    return df.select(*keys, F.posexplode(vector)).select(
        *keys, F.col("pos").alias("dim"), _r(F.col("col")).alias("value")
    )


def _buckets(rows: int) -> int:
    return max(4, rows // ROWS_PER_BUCKET)


# --- distances, assignment, one round --------------------------------------------------


def sq_distance(spark, sf):
    pts = embedding_points(spark, sf)
    leaders = pts.groupBy("label").agg(F.min_by("features", "record_id").alias("leader"))
    return pts.join(leaders, "label").select(
        "record_id", _r(squared_euclidean(F.col("features"), F.col("leader"))).alias("distance_sq")
    )


def pack_unpack(spark, sf):
    packed = raw_lines(spark, sf).select("record_id", pack(*MEASURES).alias("features"))
    return packed.select("record_id", *unpack(F.col("features"), len(MEASURES)))


def uniform_draws(spark, sf):
    key = row_key(F.col("o_orderkey"))
    return table(spark, sf, "orders").select(
        "o_orderkey", key.alias("key"), *[_r(uniform(key, 42, j), 9).alias(f"u{j}") for j in range(3)]
    )


def assign_nearest(spark, sf):
    pts = embedding_points(spark, sf)
    scored = assigning.assign(pts, starting_centers(pts, EMBEDDING_K))
    return scored.select("record_id", "cluster", _r("distance_sq").alias("distance_sq"))


def assign_lines(spark, sf):
    pts = line_points(spark, sf)
    scored = assigning.assign(pts, starting_centers(pts, LINE_K))
    return scored.select("record_id", "cluster", _r("distance_sq").alias("distance_sq"))


def cluster_means(spark, sf):
    return _long(lloyd.cluster_means(embedding_points(spark, sf), "label"), "cluster", "n")


def cluster_statistics(spark, sf):
    pts = line_points(spark, sf)
    found = lloyd.cluster_statistics(pts, starting_centers(pts, LINE_K))
    sums = [_r(F.col("sums")[i], 4).alias(f"s{i}") for i in range(len(MEASURES))]
    return found.select("cluster", "n", _r("sse", 4).alias("sse"), *sums)


def lloyd_step(spark, sf):
    pts = line_points(spark, sf)
    return _step_frame(spark, lloyd.lloyd_step(pts, starting_centers(pts, LINE_K)))


def _step_frame(spark, step: lloyd.Step) -> DataFrame:
    centers = assigning.centers_frame(spark, step.centers)
    counts = F.array(*[F.lit(n).cast("bigint") for n in step.counts])
    return centers.select(
        "cluster",
        F.get(counts, F.col("cluster")).alias("n"),
        *_coordinates("center", len(MEASURES)),
        _r(F.lit(step.sse), 4).alias("step_sse"),
        _r(F.lit(step.max_center_shift)).alias("max_center_shift"),
    )


def empty_cluster_kept(spark, sf):
    pts = line_points(spark, sf)
    start = np.vstack([starting_centers(pts, LINE_K), FAR_AWAY])
    assigned = assigning.assign(pts, start)
    kept = lloyd.keep_empty(lloyd.cluster_means(assigned), start)
    return kept.select("cluster", "n", *_coordinates("center", len(MEASURES)))


def max_center_shift(spark, sf):
    pts = line_points(spark, sf)
    start = starting_centers(pts, LINE_K)
    moved = lloyd.keep_empty(lloyd.cluster_means(assigning.assign(pts, start)), start)
    shift = lloyd.max_center_shift(assigning.centers_frame(spark, start), moved)
    return shift.select(_r("max_center_shift").alias("max_center_shift"))


def sse_of_assignment(spark, sf):
    pts = embedding_points(spark, sf)
    total = assigning.sse(pts.withColumnRenamed("label", "cluster"), starting_centers(pts, EMBEDDING_K))
    return total.select(_r("sse").alias("sse"))


def evaluate_centers(spark, sf):
    pts = line_points(spark, sf)
    found = assigning.evaluate_centers(pts, np.vstack([starting_centers(pts, LINE_K), FAR_AWAY]))
    return found.select("cluster", "n", _r("sse", 4).alias("sse"))


def cluster_sizes(spark, sf):
    pts = embedding_points(spark, sf)
    return assigning.cluster_sizes(pts, starting_centers(pts, EMBEDDING_K))


# --- fitting ---------------------------------------------------------------------------


def _model_frame(spark, centers, counts, error) -> DataFrame:
    sizes = F.array(*[F.lit(n).cast("bigint") for n in counts])
    return assigning.centers_frame(spark, centers).select(
        "cluster",
        F.get(sizes, F.col("cluster")).alias("n"),
        *_coordinates("center", len(centers[0])),
        _r(F.lit(error), 4).alias("total_sse"),
    )


def _lines_fit(spark, sf, **options):
    pts, _ = counted_lines(spark, sf)
    return lloyd.lloyd_fit(pts, starting_centers(pts, LINE_K), relative_tolerance=SETTLED, **options)


def _settled_frame(spark, fit) -> DataFrame:
    frame = _model_frame(spark, fit.centers, fit.cluster_counts, fit.sse)
    return frame.withColumns({"iterations": F.lit(fit.iterations), "converged": F.lit(fit.converged)})


def lloyd_fit(spark, sf):
    return _settled_frame(spark, _lines_fit(spark, sf))


def lloyd_settles(spark, sf):
    """The stop rule: rounds until the error hardly changes, well below the limit."""
    return _settled_frame(spark, _lines_fit(spark, sf, tolerance=0.0))


def lloyd_history(spark, sf):
    return (
        _lines_fit(spark, sf)
        .history_frame(spark)
        .select(
            "iteration",
            _r("sse", 4).alias("sse"),
            _r("max_center_shift").alias("max_center_shift"),
            F.concat_ws(";", F.col("cluster_counts").cast("array<string>")).alias("cluster_counts"),
        )
    )


def lloyd_fit_embeddings(spark, sf):
    pts = embedding_points(spark, sf)
    fit = lloyd.lloyd_fit(pts, starting_centers(pts, EMBEDDING_K), tolerance=0.0)
    return _long(assigning.centers_frame(spark, fit.centers), "cluster").withColumn("converged", F.lit(fit.converged))


def kmeanspp_seeds(spark, sf):
    seeds = [42 + i for i in range(RESTARTS)]
    found = seeding.kmeanspp_seeds(embedding_points(spark, sf), EMBEDDING_K, seeds)
    rows = [(seed, c, v.tolist()) for seed, run in zip(seeds, found) for c, v in enumerate(run)]
    frame = spark.createDataFrame(rows, "seed int, cluster int, center array<double>")
    return _long(frame, "seed", "cluster")


def oversampled_seeds(spark, sf):
    """Starting centres from few scans: sampled rows, weighted by the points nearest to them."""
    seeds = [42 + i for i in range(RESTARTS)]
    found = seeding.oversampled_seeds(embedding_points(spark, sf), EMBEDDING_K, seeds, rounds=OVERSAMPLING_ROUNDS)
    rows = [(seed, c, v.tolist()) for seed, run in zip(seeds, found) for c, v in enumerate(run)]
    frame = spark.createDataFrame(rows, "seed int, cluster int, center array<double>")
    return _long(frame, "seed", "cluster")


def bucket_counts(spark, sf):
    lines = raw_lines(spark, sf)
    n = _buckets(lines.count())
    return with_bucket(lines, n).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def partition_counts(spark, sf):
    lines = raw_lines(spark, sf)
    n = _buckets(lines.count())
    placed = with_bucket(lines, n).repartitionById(n, F.col("bucket"))
    return count_partition_records(placed)


def _local_lines(spark, sf):
    pts = line_points(spark, sf)
    return local.partition_kmeans(
        pts, LINE_K, n_buckets=_buckets(pts.count()), max_iterations=LOCAL_ROUNDS, tolerance=0.0
    )


def bucket_local_kmeans(spark, sf):
    flat = _local_lines(spark, sf).select("bucket", "record_count", "sse", F.posexplode("centers").alias("cluster", "center"))
    return flat.select(
        "bucket", "record_count", _r("sse", 4).alias("sse"), "cluster", *_coordinates("center", len(MEASURES))
    )


def candidate_pool(spark, sf):
    pool = local.collect_candidates(_local_lines(spark, sf))
    return pool.select("record_id", "bucket", "cluster", "record_count", *_coordinates("features", len(MEASURES)))


def candidate_restarts(spark, sf):
    pool = local.collect_candidates(_local_lines(spark, sf))
    seeds = [42 + i for i in range(RESTARTS)]
    runs = local.restart_table(pool, LINE_K, seeds, LOCAL_ROUNDS, 0.0)
    return runs.select("seed", "record_count", _r("sse").alias("sse"))


FLAGSHIP = {
    "local_max_iterations": LOCAL_ROUNDS,
    "local_tolerance": 0.0,
    "global_cost_tolerance": 0.0,
    "global_relative_tolerance": SETTLED,
    "aggregation_restarts": RESTARTS,
    "tie_width": TIE_WIDTH,
}


def parallel_kmeans(spark, sf):
    pts, rows = counted_lines(spark, sf)
    model = clustering.parallel_kmeans(pts, LINE_K, n_buckets=_buckets(rows), **FLAGSHIP)
    model.release()
    return _settled_frame(spark, model)


def parallel_kmeans_partitions(spark, sf):
    """The shuffle-free form: groups are the partitions as they lie, here one for each bucket."""
    n = _buckets(table(spark, sf, "lineitem").count())
    lines = with_bucket(line_points(spark, sf).drop("label"), n)
    with materialized(lines.repartitionById(n, F.col("bucket")).drop("bucket")) as (placed, _):
        model = clustering.parallel_kmeans(placed, LINE_K, **FLAGSHIP)
    model.release()
    return _settled_frame(spark, model)


def multi_init_kmeans(spark, sf):
    found, model = _multi_init(spark, embedding_points(spark, sf), EMBEDDING_K, tolerance=0.0)
    return found


def multi_init_distributed(spark, sf):
    """The same by distributed rounds over the lines, each of which serves all seeds."""
    pts, _ = counted_lines(spark, sf)
    found, model = _multi_init(spark, pts, LINE_K, tolerance=CENTERS_REST, distributed=True)
    rounds = spark.createDataFrame([(fit.seed, fit.iterations) for fit in model.runs], "seed bigint, iterations int")
    return found.join(rounds, "seed")


def _multi_init(spark, pts, k, **options):
    model = clustering.multi_init_kmeans(pts, k, num_initializations=RESTARTS, tie_width=TIE_WIDTH, **options)
    found = model.runs_frame(spark).select(
        "seed",
        _r("sse").alias("sse"),
        F.concat_ws(";", F.col("cluster_counts").cast("array<string>")).alias("cluster_counts"),
        (F.col("seed") == model.best.seed).alias("best"),
        "converged",
    )
    return found, model


def best_of_runs(spark, sf):
    runs = event_trials(spark, sf).groupBy(F.col("size").alias("run")).agg(F.round(F.avg("sse"), 1).alias("sse"))
    return local.best_run(runs).select("run", "sse")


def predict_labeled(spark, sf):
    pts = embedding_points(spark, sf)
    found = assigning.predict(pts, starting_centers(pts, EMBEDDING_K))
    return found.select("record_id", "label", "cluster")


def labeled_run(spark, sf):
    pts, rows = counted_lines(spark, sf)
    run = clustering.labeled_run(pts, LINE_K, n_buckets=_buckets(rows), **FLAGSHIP)
    run.model.release()
    sizes = run.predictions.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumns({"iterations": F.lit(run.model.iterations), "converged": F.lit(run.model.converged)})


def labeled_predictions(spark, sf):
    """The labelled run from two seeds, written as one prediction table and read back."""
    path = scratch_path(spark, "predictions")
    pts, rows = counted_lines(spark, sf)
    runs = clustering.labeled_repetitions(
        pts, LINE_K, dataset_name="lines", repetitions=2, n_buckets=_buckets(rows), **FLAGSHIP
    )
    writers.write_predictions(runs.predictions, path, records=rows, repetitions=2)
    runs.release()
    return spark.read.parquet(path)


# --- quality ---------------------------------------------------------------------------


def _assigned_embeddings(spark, sf):
    pts = embedding_points(spark, sf)
    return assigning.assign(pts, starting_centers(pts, EMBEDDING_K))


def _assigned_lines(spark, sf):
    pts = line_points(spark, sf)
    return assigning.assign(pts, starting_centers(pts, LINE_K))


def contingency(spark, sf):
    return quality.contingency(_assigned_lines(spark, sf))


def purity(spark, sf):
    return quality.purity(_assigned_embeddings(spark, sf)).select(_r("purity").alias("purity"))


def ari(spark, sf):
    return quality.adjusted_rand_index(_assigned_embeddings(spark, sf)).select(_r("ari").alias("ari"))


def nmi(spark, sf):
    return quality.normalized_mutual_information(_assigned_embeddings(spark, sf)).select(_r("nmi").alias("nmi"))


def cardinalities(spark, sf):
    return quality.cardinalities(_assigned_embeddings(spark, sf))


def quality_row(spark, sf):
    row = quality.evaluate_quality(_assigned_lines(spark, sf))
    return row.select(
        *[_r(m).alias(m) for m in ("ari", "nmi", "purity")], "num_records", "num_classes", "num_clusters"
    )


def quality_of_text_labels(spark, sf):
    orders = table(spark, sf, "orders")
    row = quality.evaluate_quality(orders, "o_orderpriority", "o_orderstatus")
    return row.select(
        *[_r(m).alias(m) for m in ("ari", "nmi", "purity")], "num_records", "num_classes", "num_clusters"
    )


def _two_assignments(spark, sf):
    """The same assignment by Arrow batches and by compiled columns."""
    pts = line_points(spark, sf)
    start = starting_centers(pts, LINE_K)
    compiled = pts.withColumn("best", nearest_center(F.col("features"), start.tolist()))
    return assigning.assign(pts, start), compiled.select("features", "best.cluster", "best.distance_sq")


def cross_check(spark, sf):
    left, right = _two_assignments(spark, sf)
    return quality.cross_check(quality.run_fingerprint(left, LINE_K), quality.run_fingerprint(right, LINE_K))


def cross_check_renumbered(spark, sf):
    """Clusters with other numbers, one of them empty: the same sizes and error do not agree."""
    left, right = _two_assignments(spark, sf)
    moved = right.withColumn("cluster", F.when(F.col("cluster") == 0, LINE_K).otherwise(F.col("cluster")))
    return quality.cross_check(quality.run_fingerprint(left, LINE_K + 1), quality.run_fingerprint(moved, LINE_K + 1))


# --- preparation -----------------------------------------------------------------------


def normalize_label(spark, sf):
    return noisy_orders(spark, sf).select("record_id", prepare.normalize_label(F.col("label")).alias("label"))


def _mapped_orders(spark, sf):
    cleaned = noisy_orders(spark, sf).withColumn("label", prepare.normalize_label(F.col("label")))
    return prepare.map_category(cleaned, "label", PRIORITY_CLASS)


def map_category(spark, sf):
    return _mapped_orders(spark, sf).select("record_id", "label", "category")


def unmapped_labels(spark, sf):
    partial = {label: kind for label, kind in PRIORITY_CLASS.items() if kind == "fast"}
    cleaned = noisy_orders(spark, sf).withColumn("label", prepare.normalize_label(F.col("label")))
    return prepare.unmapped_labels(prepare.map_category(cleaned, "label", partial), "label")


def drop_class(spark, sf):
    return prepare.drop_class(_mapped_orders(spark, sf), "category", DROPPED_CLASS).select("record_id", "category")


def drop_report(spark, sf):
    return prepare.drop_report(_mapped_orders(spark, sf), "category", DROPPED_CLASS)


def ordinal_encode(spark, sf):
    kept = prepare.drop_class(_mapped_orders(spark, sf), "category", DROPPED_CLASS)
    return prepare.ordinal_encode(kept, ["label", "o_orderstatus"]).select("record_id", "label", "o_orderstatus")


def encode_label(spark, sf):
    return _mapped_orders(spark, sf).select(
        "record_id", prepare.encode_label(F.col("category"), CLASS_NAMES).alias("label")
    )


def standardize(spark, sf):
    scaled = prepare.standardize(raw_lines(spark, sf), MEASURES)
    return scaled.select("record_id", *[_r(m).alias(m) for m in MEASURES])


def validate_points(spark, sf):
    return points.points_summary(embedding_points(spark, sf), "label")


def class_histogram(spark, sf):
    return points.class_histogram(line_points(spark, sf))


def nested_prefixes(spark, sf):
    rows = noisy_orders(spark, sf).select("record_id", "o_totalprice", "year", "constant")
    sizes = [rows.count() // part for part in PREFIX_PARTS]
    nested = prepare.nested_prefixes(rows, sizes, ["o_totalprice", "year", "constant"])
    return nested.select("size", "record_id", *[_r(c).alias(c) for c in ("o_totalprice", "year", "constant")])


def exact_sample(spark, sf):
    return points.exact_sample(raw_lines(spark, sf), SAMPLE_ROWS).select("record_id", *MEASURES)


def record_ids(spark, sf):
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    numbered = points.assign_record_id(table(spark, sf, "lineitem").select(*order), order)
    return numbered.select("record_id", *order)


def prep_summary(spark, sf):
    return prepare.prep_summary(
        _mapped_orders(spark, sf), category="category", dropped=DROPPED_CLASS, features=4, expected_rows=10_000
    )


def prepare_orders(spark, sf):
    prepared = prepare_table(
        noisy_orders(spark, sf),
        features=["o_orderstatus", "o_totalprice", "year", "constant"],
        categorical=["o_orderstatus"],
        mapping=PRIORITY_CLASS,
        dropped=DROPPED_CLASS,
        label_names=CLASS_NAMES,
        expected_rows=10_000,
    )
    return prepared.points.select("record_id", *_coordinates("features", 4), "label")


# --- files -----------------------------------------------------------------------------


def points_csv_round_trip(spark, sf):
    """Sorted lines written to many files: ids are places in the sorted order."""
    path = scratch_path(spark, "points-csv")
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    lines = table(spark, sf, "lineitem").repartitionByRange(*order).sortWithinPartitions(*order)
    lines = lines.select(pack(*MEASURES).alias("features"))
    writers.write_points_csv(lines, path, len(MEASURES))
    back = readers.read_points_csv(spark, path, len(MEASURES), expected_rows=table(spark, sf, "lineitem").count())
    return back.select("record_id", *unpack(F.col("features"), len(MEASURES)))


def labeled_csv_round_trip(spark, sf):
    """Files whose columns stand in two orders; every feature, label and id is compared."""
    path = scratch_path(spark, "labeled-csv")
    wide = embedding_points(spark, sf).select("record_id", *unpack(F.col("features"), 64), "label")
    columns = [c for c in wide.columns if c != "record_id"]
    for part, names in enumerate((columns, columns[::-1])):
        half = wide.where(F.pmod("record_id", F.lit(2)) == part)
        placed = half.repartitionByRange(3, "record_id").sortWithinPartitions("record_id")
        placed.select(*names).write.option("header", True).csv(f"{path}/part{part}")
    return _long(readers.read_labeled_csv(spark, f"{path}/part*"), "record_id", "label", vector="features")


def parquet_round_trip(spark, sf):
    directory = scratch_path(spark, "dataset")
    writers.save_dataset(embedding_points(spark, sf), "vectors", directory, 64)
    back = readers.load_dataset(spark, "vectors", directory)
    flat = back.select("label", F.posexplode("features"))
    return flat.groupBy("label", F.col("pos").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), _r(F.sum("col")).alias("total")
    )


def features_labels_split(spark, sf):
    directory = scratch_path(spark, "split")
    features, labels = writers.split_features_labels(line_points(spark, sf), directory, "lines", LINE_K)
    left, right = spark.read.parquet(features), spark.read.parquet(labels)
    return left.join(right, "record_id").select("record_id", *_coordinates("features", len(MEASURES)), "label")


def write_sample(spark, sf):
    path = scratch_path(spark, "sample")
    writers.write_sample(line_points(spark, sf), path, len(MEASURES), SAMPLE_ROWS)
    text = spark.read.option("header", True).csv(path)
    values = [(F.col(f"f{i}").cast("double") + 0.0).alias(f"f{i}") for i in range(len(MEASURES))]
    return text.select(*values, "label")


def trials_round_trip(spark, sf):
    """Two appends of the same measurements are read back as one table."""
    path = scratch_path(spark, "trials")
    number = F.col("total_runtime_seconds")
    fixed = {
        "num_records": F.lit(1), "num_features": F.lit(1), "num_clusters": F.lit(3), "num_partitions": F.lit(4),
        "local_max_iterations": F.lit(100), "global_max_iterations": F.lit(100), "local_tolerance": F.lit(1e-6),
        "global_cost_tolerance": F.lit(1e-6), "aggregation_restarts": F.lit(5), "materialized_record_count": F.lit(1),
        "partition_clustering_seconds": number, "center_aggregation_seconds": number,
        "initialization_seconds": number, "global_clustering_seconds": number, "final_evaluation_seconds": number,
    }
    rows = event_trials(spark, sf).select(
        F.lit("e").alias("experiment_id"),
        F.col("configuration").alias("dataset_name"),
        F.lit("local[1]").alias("spark_master"),
        F.col("size").alias("random_seed"),
        "converged",
        "iterations",
        "sse",
        F.array(F.col("size"), F.lit(0), F.col("iterations")).alias("cluster_counts"),
        "total_runtime_seconds",
        *[value.alias(name) for name, value in fixed.items()],
    )
    for _ in range(2):
        writers.append_trial(rows, path, format="csv")
    back = readers.read_trials(spark, path, format="csv")
    return back.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("converged").alias("converged_runs"),
        _r(F.sum("total_runtime_seconds"), 4).alias("seconds"),
        F.sum(F.col("cluster_counts")[2]).alias("last_counts"),
    )


def trials_appended_once(spark, sf):
    """Half of the measurements, then all, then all again: each is there once, in all its columns."""
    path = scratch_path(spark, "trials")
    seconds, event, user = F.col("value"), F.col("event_id"), F.col("user_id")
    columns = {
        "experiment_id": event, "dataset_name": F.col("event_type"), "num_records": event, "num_features": F.lit(4),
        "num_clusters": F.lit(3), "num_partitions": F.lit(8), "spark_master": F.lit("local[1]"), "random_seed": user,
        "local_max_iterations": F.lit(100), "global_max_iterations": F.lit(50), "local_tolerance": F.lit(1e-6),
        "global_cost_tolerance": F.lit(1e-4), "aggregation_restarts": F.lit(5), "materialized_record_count": event,
        "converged": seconds < 100, "iterations": user, "sse": seconds * seconds,
        "cluster_counts": F.array(user, F.lit(0), event), "partition_clustering_seconds": seconds,
        "center_aggregation_seconds": seconds / 2, "initialization_seconds": seconds / 4,
        "global_clustering_seconds": seconds * 2, "final_evaluation_seconds": seconds / 8,
        "total_runtime_seconds": seconds * 4,
    }
    trials = table(spark, sf, "events").select(*[value.alias(name) for name, value in columns.items()])
    for rows in (trials.where(F.col("num_records") % 2 == 0), trials, trials):
        writers.append_trials_once(rows, path, format="csv")
    back = readers.read_trials(spark, path, format="csv")
    return back.withColumn("cluster_counts", F.concat_ws(";", F.col("cluster_counts").cast("array<string>")))


def write_predictions(spark, sf):
    pts = embedding_points(spark, sf)
    runs = {
        (repetition, 41 + repetition): assigning.assign(pts, starting_centers(pts, EMBEDDING_K, 41 + repetition))
        for repetition in (1, 2)
    }
    path = scratch_path(spark, "predictions")
    rows = pts.count()
    writers.write_predictions(writers.predictions_table(runs, "vectors"), path, records=rows, repetitions=2)
    return spark.read.parquet(path)


def exact_partitions(spark, sf):
    placed = [exact_partition_counts(table(spark, sf, "lineitem"), n) for n in (1, 6, 11)]
    return placed[0].unionByName(placed[1]).unionByName(placed[2])


def exact_partition_counts(df: DataFrame, n: int) -> DataFrame:
    counts = count_partition_records(exactly(df, n))
    return counts.agg(F.lit(n).alias("wanted"), F.count(F.lit(1)).alias("partitions"), F.sum("records").alias("records"))


def quality_table_round_trip(spark, sf):
    path = scratch_path(spark, "quality")
    fixed = {
        "records": F.lit(1000), "features": F.lit(4), "clusters": F.lit(3), "sse": F.lit(1.5),
        "cluster_counts": F.lit("1;2;3"), "iterations": F.lit(4), "converged": F.lit("True"),
    }
    measured = order_measurements(spark, sf).withColumns(fixed)
    measured.coalesce(1).write.option("header", True).csv(path)  # a few rows; the header is per file
    back = readers.read_quality_table(spark, path)
    return back.select(
        "dataset",
        "algorithm",
        "master",
        *[_r(c).alias(c) for c in ("purity", "ari", "nmi", "elapsed_seconds")],
        F.aggregate("cluster_counts", F.lit(0).cast("bigint"), lambda total, n: total + n).alias("members"),
        "converged",
    )


def prepare_kdd_files(spark, sf):
    """Orders written as gzip connection records, then prepared from the files to a saved dataset."""
    orders = table(spark, sf, "orders")
    attack = F.create_map(*[F.lit(v) for pair in ATTACK_OF_PRIORITY.items() for v in pair])
    given = {
        "duration": F.col("o_totalprice"),
        "protocol_type": F.col("o_orderstatus"),
        "service": F.year("o_orderdate").cast("string"),
        "flag": F.lit("SF"),
        "src_bytes": F.col("o_custkey"),
    }
    columns = [given.get(name, F.lit(float(i))).alias(name) for i, name in enumerate(kdd.COLUMNS)]
    path, directory = scratch_path(spark, "connections"), scratch_path(spark, "prepared")
    raw = orders.select(*columns, F.concat(F.lit(" "), attack[F.col("o_orderpriority")], F.lit(".")).alias("label"))
    raw.write.option("compression", "gzip").option("ignoreLeadingWhiteSpace", False).csv(path)
    prepare_kdd(readers.read_kdd_csv(spark, path), directory)
    saved = readers.load_dataset(spark, "kdd99", directory)
    total = F.aggregate("features", F.lit(0.0), lambda a, b: a + F.abs(b))
    return saved.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        _r(F.avg(total)).alias("mean_size"),
        *[_r(F.avg(F.col("features")[i])).alias(f"m{i}") for i in range(5)],
    )


# --- trials ----------------------------------------------------------------------------


def trial_runs(spark, sf):
    """Everything that a trial records but its seconds."""
    with cached_lines(spark, sf) as (pts, rows):
        n = _buckets(rows)
        runs = run_trials(pts, LINE_K, dataset_name="lines", repetitions=2, n_buckets=n, **FLAGSHIP)
    return runs.select(
        "experiment_id", "dataset_name", "num_records", "num_features", "num_clusters", "num_partitions", "random_seed",
        "local_max_iterations", "global_max_iterations", "aggregation_restarts", "materialized_record_count", "converged",
        "iterations", _r("sse", 4).alias("sse"), F.concat_ws(";", F.col("cluster_counts").cast("array<string>")).alias("cluster_counts"),
    )


def trial_summary(spark, sf):
    measures = ("iterations", "sse", "total_runtime_seconds")
    found = trials.summarize_trials(event_trials(spark, sf), ["configuration"], measures)
    rounded = [_r(f"{part}_{m}", 4).alias(f"{part}_{m}") for m in measures for part in ("mean", "std")]
    return found.select(
        "configuration", "repetitions", "converged_runs", _r("convergence_rate").alias("convergence_rate"), *rounded
    )


def convergence_rate(spark, sf):
    found = trials.convergence_rate(event_trials(spark, sf), ["configuration", "size"])
    return found.select("configuration", "size", _r("convergence_rate").alias("convergence_rate"))


def speedup(spark, sf):
    summary = trials.summarize_trials(event_trials(spark, sf), ["size", "configuration"], ["total_runtime_seconds"])
    found = trials.speedup(summary, size="size", configuration="configuration", base="click")
    return found.select(
        "size",
        "configuration",
        _r("speedup").alias("speedup"),
        _r("runtime_reduction_percent").alias("runtime_reduction_percent"),
    )


def quality_comparison(spark, sf):
    found = trials.quality_comparison(order_measurements(spark, sf))
    texts = ("dataset", "base_master", "comparison_master")
    return found.select(*texts, *[_r(c).alias(c) for c in found.columns if c not in texts])


# --- generation ------------------------------------------------------------------------


def _order_ids(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"))


def balanced_sizes(spark, sf):
    ids = _order_ids(spark, sf)
    label = generate.balanced_label(F.col("record_id"), ids.count(), 7)
    return ids.groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"), F.max("record_id").alias("last")
    )


def zero_spread_blobs(spark, sf):
    ids = _order_ids(spark, sf)
    label = generate.balanced_label(F.col("record_id"), ids.count(), 5)
    blobs = generate.blobs_from_ids(ids, label, generate.diagonal_centers(5, 4), 0.0, 42)
    return blobs.select("record_id", "label", *_coordinates("features", 4))


def diagonal_blobs(spark, sf):
    ids = _order_ids(spark, sf)
    label = generate.balanced_label(F.col("record_id"), ids.count(), 5)
    blobs = generate.blobs_from_ids(ids, label, generate.diagonal_centers(5, 4), 1.5, 42)
    return blobs.select("record_id", "label", *_coordinates("features", 4))


def uniform_blobs(spark, sf):
    ids = _order_ids(spark, sf)
    centers = generate.uniform_centers(5, 20, 42)
    blobs = generate.blobs_from_ids(ids, generate.mixed_label(F.col("record_id"), 5, 42), centers, 1.0, 42)
    return blobs.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[_r(F.avg(F.col("features")[i])).alias(f"m{i}") for i in range(20)]
    )


def size_ladder(spark, sf):
    ids = _order_ids(spark, sf)
    centers = generate.uniform_centers(5, 4, 42)
    blobs = generate.blobs_from_ids(ids, generate.mixed_label(F.col("record_id"), 5, 42), centers, 1.0, 42)
    names = [f"f{i}" for i in range(4)]
    wide = blobs.select("record_id", *[F.col("features")[i].alias(n) for i, n in enumerate(names)], "label")
    nested = prepare.nested_prefixes(wide, [ids.count() // part for part in PREFIX_PARTS], names)
    return nested.groupBy("size", "label").agg(F.count(F.lit(1)).alias("n"), *[_r(F.avg(n)).alias(n) for n in names])


ALL: tuple[Query, ...] = (
    sq_distance, pack_unpack, uniform_draws, assign_nearest, assign_lines, cluster_means, cluster_statistics,
    lloyd_step, empty_cluster_kept, max_center_shift, sse_of_assignment, evaluate_centers, cluster_sizes,
    lloyd_fit, lloyd_settles, lloyd_history, lloyd_fit_embeddings, kmeanspp_seeds, oversampled_seeds,
    bucket_counts, partition_counts,
    bucket_local_kmeans, candidate_pool, candidate_restarts, parallel_kmeans, parallel_kmeans_partitions,
    multi_init_kmeans, multi_init_distributed, best_of_runs, predict_labeled, labeled_run, labeled_predictions,
    contingency, purity, ari, nmi, cardinalities, quality_row, quality_of_text_labels, cross_check,
    cross_check_renumbered,
    normalize_label, map_category, unmapped_labels, drop_class, drop_report, ordinal_encode, encode_label,
    standardize, validate_points, class_histogram, nested_prefixes, exact_sample, record_ids, prep_summary,
    prepare_orders, points_csv_round_trip, labeled_csv_round_trip, parquet_round_trip, features_labels_split,
    write_sample, trials_round_trip, trials_appended_once, write_predictions, exact_partitions, quality_table_round_trip,
    prepare_kdd_files, trial_runs, trial_summary, convergence_rate, speedup,
    quality_comparison, balanced_sizes, zero_spread_blobs, diagonal_blobs, uniform_blobs, size_ladder,
)
