import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from centroidal.functions.kernels import fit_group
from centroidal.functions.keys import hash_bucket
from centroidal.operators.seeding import keyed
from centroidal.plans import clustering as P
from centroidal.sources.readers import read_points_csv
from centroidal.sources.writers import write_points_csv
from tests.fixtures import DEMO, TWELVE


@pytest.mark.parametrize("n_buckets", [None, 1])
def test_two_clusters(make_points, n_buckets):
    model = P.parallel_kmeans(
        make_points(TWELVE).coalesce(1), 2, n_buckets=n_buckets, local_tolerance=1e-12, global_cost_tolerance=1e-12
    )
    assert model.converged
    assert np.allclose(sorted(map(tuple, model.centers)), [(1 + 1 / 30,) * 2, (9 + 1 / 30,) * 2])
    assert model.cluster_counts == (6, 6)
    assert (model.num_records, model.num_groups, model.candidate_count) == (12, 1, 2)
    assert model.candidates.count() == 2
    assert set(model.seconds) == {
        "partition_clustering_seconds",
        "center_aggregation_seconds",
        "initialization_seconds",
        "global_clustering_seconds",
        "final_evaluation_seconds",
        "total_runtime_seconds",
    }
    model.release()


def test_demo(make_points):
    model = P.parallel_kmeans(make_points(DEMO).repartition(2), 4)
    assert model.sse == pytest.approx(0.906667, abs=1e-6)
    assert model.cluster_counts == (6, 6, 6, 6)


def test_label_column_does_not_matter(make_points):
    plain = P.parallel_kmeans(make_points(DEMO), 4, n_buckets=2)
    labelled = P.parallel_kmeans(make_points(DEMO, list(range(24))), 4, n_buckets=2)
    assert (plain.centers == labelled.centers).all()


def test_file_and_memory_give_the_same_model(spark, make_points, tmp_path):
    path = write_points_csv(make_points(DEMO * 5).coalesce(1), str(tmp_path / "points"), 2)
    memory = P.parallel_kmeans(make_points(DEMO * 5), 4, n_buckets=3)
    file = P.parallel_kmeans(read_points_csv(spark, path, 2, expected_rows=120, n_partitions=4), 4, n_buckets=3)
    assert np.allclose(memory.centers, file.centers)
    assert memory.sse == pytest.approx(file.sse) and memory.cluster_counts == file.cluster_counts


def test_whole_job_against_an_independent_computation(make_points):
    """All three stages redone on the driver for a small table."""
    rng = np.random.default_rng(11)
    points = make_points(rng.normal(size=(300, 3)).tolist())
    k, buckets, restarts = 4, 3, 4
    model = P.parallel_kmeans(points, k, n_buckets=buckets, aggregation_restarts=restarts, global_cost_tolerance=1e-9)



    rows = keyed(points).collect()
    numbers = points.select(hash_bucket(F.col("record_id"), buckets).alias("b")).collect()
    block, keys = np.array([r.features for r in rows]), np.array([r.key for r in rows])
    bucket = np.array([r.b for r in numbers])
    pool = [fit_group(block[bucket == b], keys[bucket == b], k, 100, 1e-6, 42 + b).centers for b in range(buckets)]
    pool = np.concatenate(pool)
    pool_points = make_points(pool.tolist())
    pool_keys = np.array([r.key for r in keyed(pool_points).collect()])
    fits = [fit_group(pool, pool_keys, k, 100, 1e-6, 42 + s) for s in range(restarts)]
    centers = min(fits, key=lambda f: f.sse).centers
    previous = None
    while True:
        d2 = ((block[:, None] - centers) ** 2).sum(axis=2)
        labels, error = d2.argmin(axis=1), d2.min(axis=1).sum()
        centers = np.array([block[labels == c].mean(axis=0) for c in range(k)])
        if previous is not None and abs(error - previous) <= 1e-9:
            break
        previous = error
    assert np.allclose(model.centers, centers)
    assert model.cluster_counts == tuple(np.bincount(labels, minlength=k))


@pytest.mark.parametrize(
    "options",
    [
        {"k": 0},
        {"local_max_iterations": 0},
        {"global_max_iterations": 0},
        {"local_tolerance": -1.0},
        {"global_cost_tolerance": -1.0},
        {"aggregation_restarts": 0},
    ],
)
def test_bad_arguments(make_points, options):
    with pytest.raises(ValueError):
        P.parallel_kmeans(make_points(DEMO), **{"k": 2, **options})


def test_bad_tables(spark, make_points):
    with pytest.raises(ValueError, match="empty"):
        P.parallel_kmeans(make_points([]), 2)
    with pytest.raises(PySparkException, match="fewer than k"):
        P.parallel_kmeans(make_points([(0, 0)]), 2, n_buckets=1)
    ragged = make_points([(0, 0), (1, 1), (0, 0, 0), (1, 1, 1)]).repartitionById(2, F.floor(F.col("record_id") / 2).cast("int"))
    with pytest.raises(ValueError, match="2 to 3 features"):
        P.parallel_kmeans(ragged, 2)


def test_best_initialization_wins(make_points):
    points = make_points([(0, 0), (0, 1), (1, 0), (10, 10), (10, 11), (11, 10)], [0, 0, 0, 1, 1, 1])
    model = P.multi_init_kmeans(points, 2, num_initializations=4)
    assert model.best.sse == min(run.sse for run in model.runs)
    assert [run.seed for run in model.runs] == [42, 43, 44, 45]
    assert sorted(model.best.cluster_counts) == [3, 3]
    for options in ({"k": 0}, {"k": 7}, {"num_initializations": 0}, {"max_iterations": 0}, {"tolerance": -1.0}):
        with pytest.raises(ValueError):
            P.multi_init_kmeans(points, **{"k": 2, **options})


def test_labeled_run_checks_and_predicts(make_points):
    labels = [0] * 6 + [1] * 6
    run = P.labeled_run(make_points(TWELVE, labels), 2, n_buckets=1)
    rows = run.predictions.orderBy("record_id").collect()
    assert [r.record_id for r in rows] == list(range(12)) and [r.label for r in rows] == labels
    assert len({(r.label, r.cluster) for r in rows}) == 2
    assert run.sse == pytest.approx(run.model.sse)
    assert "features" not in run.predictions.columns


def test_plan_of_the_partition_stage_has_no_shuffle(make_points):
    from centroidal.operators.local import partition_kmeans

    plan = partition_kmeans(make_points(DEMO), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    plan = partition_kmeans(make_points(DEMO), 2, n_buckets=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_ids_that_the_fit_has_seen_are_not_exchanged_again(make_points, monkeypatch):
    from centroidal.operators import assign as assigning
    from centroidal.plans import clustering

    def forbidden(*_):
        raise AssertionError("the fit has told that no id repeats")

    points = make_points([(float(i % 9), float(i % 4)) for i in range(80)], [i % 3 for i in range(80)])
    monkeypatch.setattr(assigning, "require_unique", forbidden)
    run = clustering.labeled_run(points, 2, n_buckets=2)
    assert run.model.unique_ids and sum(run.cluster_counts) == 80
    monkeypatch.undo()
    repeated = points.union(points.limit(1))
    assert clustering.parallel_kmeans(repeated, 2, n_buckets=2).unique_ids is None
    with pytest.raises(ValueError, match="occurs 2 times"):
        clustering.labeled_run(repeated, 2, n_buckets=2)
    with pytest.raises(ValueError, match="occurs 2 times"):
        clustering.labeled_repetitions(repeated, 2, dataset_name="d", repetitions=1, n_buckets=2)


def test_repetitions_equal_single_runs(make_points):
    from centroidal.plans import clustering

    points = make_points([(float(i % 9), float(i * i % 7)) for i in range(90)], [i % 3 for i in range(90)])
    runs = clustering.labeled_repetitions(points, 3, dataset_name="d", repetitions=2, random_seed=5, n_buckets=2)
    rows = runs.predictions.collect()
    assert len(rows) == 180 and {(r.repetition, r.random_seed, r.dataset_name) for r in rows} == {(1, 5, "d"), (2, 6, "d")}
    for repetition in (1, 2):
        single = clustering.labeled_run(points, 3, random_seed=4 + repetition, n_buckets=2)
        wanted = {r.record_id: (r.label, r.cluster) for r in single.predictions.collect()}
        assert {r.record_id: (r.true_label, r.predicted_cluster) for r in rows if r.repetition == repetition} == wanted
    with pytest.raises(ValueError):
        clustering.labeled_repetitions(points, 3, dataset_name="d", repetitions=0)
