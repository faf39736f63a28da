import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from centroidal.functions.kernels import fit_group, nearest, race_seeds
from centroidal.operators import local as C
from centroidal.operators import seeding
from centroidal.operators.seeding import keyed, kmeanspp_seeds, oversampled_seeds
from tests.fixtures import TWELVE, RESTARTS, RESTARTS_SSE, STEP


def test_one_result_per_bucket(make_points):
    rows = C.partition_kmeans(make_points(TWELVE * 4), 2, n_buckets=3).collect()
    assert sum(r.record_count for r in rows) == 48
    assert {r.bucket for r in rows} == {0, 1, 2}
    assert all(len(r.centers) == 2 and r.converged for r in rows)


def test_one_result_per_non_empty_partition(spark, make_points):
    points = make_points(STEP).repartitionById(5, (F.col("record_id") % 2).cast("int"))
    rows = C.partition_kmeans(points, 2).collect()
    assert sorted((r.bucket, r.record_count) for r in rows) == [(0, 4), (1, 4)]


def test_buckets_do_not_depend_on_the_layout(make_points):
    def result(partitions):
        found = C.partition_kmeans(make_points(TWELVE * 5, partitions=partitions), 3, n_buckets=4)
        return sorted(map(tuple, found.select("bucket", "record_count", "sse").collect()))

    assert result(1) == result(7)


def test_groups_do_not_depend_on_arrow_batches(spark, make_points):
    def result(batch_rows):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
        try:
            points = make_points([(i, i % 7) for i in range(1001)]).coalesce(1)
            return C.partition_kmeans(points, 3, group_rows=100).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    results = [result(n) for n in (40, 333, 10_000)]
    assert results[0] == results[1] == results[2]
    assert [r.record_count for r in results[0]] == [100] * 9 + [101]


def test_a_bucket_beyond_the_bounds_is_an_error(make_points, monkeypatch):
    monkeypatch.setattr(C, "GROUP_BYTES", 8)
    with pytest.raises(PySparkException, match="use more buckets"):
        C.partition_kmeans(make_points(TWELVE), 2, n_buckets=1).collect()


@pytest.mark.parametrize("n_buckets", [None, 2])
def test_group_smaller_than_k_names_itself(make_points, n_buckets):
    points = make_points([(0, 0), (1, 1), (8, 8), (9, 9)]).repartitionById(2, (F.col("record_id") % 2).cast("int"))
    with pytest.raises(PySparkException, match=r"(bucket|partition) \d+ has \d records, fewer than k=3"):
        C.partition_kmeans(points, 3, n_buckets=n_buckets).collect()


@pytest.mark.parametrize("options", [{"k": 0}, {"k": 2, "max_iterations": 0}, {"k": 2, "tolerance": -1.0}, {"k": 2, "n_buckets": 0}])
def test_bad_arguments(make_points, options):
    with pytest.raises(ValueError):
        C.partition_kmeans(make_points(STEP), **options)


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_nonfinite_points_fail(make_points, bad):
    with pytest.raises(PySparkException, match="NaN or infinite"):
        C.partition_kmeans(make_points([(0, 0), (1, bad)]), 1).collect()


def test_candidates_are_numbered(make_points):
    pool = C.collect_candidates(C.partition_kmeans(make_points(TWELVE * 4), 2, n_buckets=3))
    rows = pool.orderBy("record_id").collect()
    assert [r.record_id for r in rows] == list(range(6))
    assert [(r.bucket, r.cluster) for r in rows] == [(b, c) for b in range(3) for c in range(2)]


def test_restarts_find_the_lowest_error(make_points):
    best = C.aggregate_candidates(make_points(RESTARTS), 4, rows=16, dimensions=2, num_restarts=5)
    assert best.converged
    assert best.sse == pytest.approx(RESTARTS_SSE)
    assert 42 <= best.seed < 47


def test_aggregation_arguments(make_points):
    with pytest.raises(ValueError, match="restarts"):
        C.aggregate_candidates(make_points(RESTARTS), 4, rows=16, dimensions=2, num_restarts=0)
    with pytest.raises(ValueError, match="fewer than k"):
        C.aggregate_candidates(make_points(RESTARTS), 17, rows=16, dimensions=2)


def test_first_of_equal_errors_wins():
    def run(seed):
        return C.SeededFit(seed, np.zeros((1, 1)), (1,), 1, True, 2.0)

    assert C.best_of([run(5), run(4)]).seed == 5
    lower = C.SeededFit(6, np.zeros((1, 1)), (1,), 1, True, 2.0 - 1e-13)
    assert C.best_of([run(5), lower]).seed == 6 and C.best_of([run(5), lower], tie_width=1e-12).seed == 5
    with pytest.raises(ValueError):
        C.best_of([])


def test_distributed_fit_equals_the_group_fit(make_points):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(c, 1.0, size=(40, 3)) for c in (0, 4, 9)])
    points = make_points(vectors.tolist(), partitions=5)
    rows = keyed(points).collect()
    block, keys = np.array([r.features for r in rows]), np.array([r.key for r in rows])
    for found in C._fit_seeds_distributed(points, 3, [1, 2, 3], 50, 1e-9):
        wanted = fit_group(block, keys, 3, 50, 1e-9, found.seed)
        assert np.allclose(found.centers, wanted.centers)
        assert found.sse == pytest.approx(wanted.sse)
        assert (found.iterations, found.converged) == (wanted.iterations, wanted.converged)
        assert list(found.cluster_counts) == wanted.counts.tolist()


def test_large_pools_take_the_distributed_path(make_points, monkeypatch):
    small = C.aggregate_candidates(make_points(RESTARTS), 4, rows=16, dimensions=2, num_restarts=3, tie_width=1e-12)
    monkeypatch.setattr(C, "GROUP_ROWS", 8)
    large = C.aggregate_candidates(make_points(RESTARTS), 4, rows=16, dimensions=2, num_restarts=3, tie_width=1e-12)
    assert large.sse == pytest.approx(small.sse) and large.seed == small.seed


def test_distributed_seeds_of_identical_points(make_points):
    seeds = kmeanspp_seeds(make_points([(1, 1)] * 4, partitions=2), 3, [1, 2])
    assert seeds.shape == (2, 3, 2) and (seeds == 1).all()
    with pytest.raises(ValueError, match="exceeds"):
        kmeanspp_seeds(make_points([(1, 1)] * 2), 3, [1])


def test_suggested_buckets_stay_bounded():
    assert C.suggested_buckets(10, 5, 20) == 1
    assert C.suggested_buckets(10_000_001, 5, 20) == 101
    assert C.suggested_buckets(10**12, 10, 20) * C.GROUP_ROWS >= 10**12
    assert C.suggested_buckets(1000, 10, 10**9) == 3  # never so many that a bucket could fall below k


def test_seeds_equal_those_of_one_group(make_points, monkeypatch):
    """Distances kept from draw to draw give the rows that measuring all chosen rows gives, also over written states."""
    monkeypatch.setattr(seeding, "REFRESH", 2)
    monkeypatch.setattr(seeding, "LINEAGE", 3)
    rng = np.random.default_rng(8)
    points = make_points(rng.normal(size=(300, 3)).tolist(), partitions=5)
    rows = keyed(points).toArrow()
    block, keys = np.array(rows.column("features").to_pylist()), rows.column("key").to_numpy()
    found = kmeanspp_seeds(points, 9, [1, 7])
    for run, seed in zip(found, (1, 7)):
        assert run.tolist() == race_seeds(block, keys, 9, seed).tolist()


def test_a_draw_measures_against_few_rows(make_points, monkeypatch):
    measured = []
    offers = seeding._offers

    def watched(draw, seeds, recent):
        measured.append([len(rows) for _, rows in recent])
        return offers(draw, seeds, recent)

    monkeypatch.setattr(seeding, "_offers", watched)
    monkeypatch.setattr(seeding, "REFRESH", 3)
    kmeanspp_seeds(make_points([(float(i), float(i % 5)) for i in range(60)]), 8, [3, 4])
    assert measured == [[n, n] for n in (0, 1, 2, 0, 1, 2, 0, 1)]


def test_oversampled_seeds(make_points, monkeypatch):
    rng = np.random.default_rng(9)
    block = np.concatenate([rng.normal(c, 0.05, size=(80, 2)) for c in range(0, 40, 4)])
    points = make_points(block.tolist(), partitions=4)
    found = oversampled_seeds(points, 10, [5, 6], rounds=4)
    for run in found:
        assert len(np.unique(run, axis=0)) == 10 and all(row in block.tolist() for row in run.tolist())
        assert nearest(block, run)[1].max() < 1.0  # a centre in every blob
    again = oversampled_seeds(points.repartition(3), 10, [5, 6], rounds=4)
    assert again.tolist() == found.tolist()
    scans = []
    monkeypatch.setattr(seeding, "_kept", lambda recent, real=seeding._kept: scans.append(1) or real(recent))
    oversampled_seeds(points, 10, [5], rounds=3)
    assert len(scans) == 3  # not one for each of the ten centres


def test_oversampling_a_table_of_few_different_rows(make_points):
    points = make_points([(1.0, 1.0)] * 30 + [(2.0, 2.0)] * 3, partitions=3)
    (run,) = oversampled_seeds(points, 3, [1])
    assert len(run) == 3 and {tuple(r) for r in run} == {(1.0, 1.0), (2.0, 2.0)}
    with pytest.raises(ValueError):
        oversampled_seeds(points, 3, [1], rounds=0)


def test_an_overfull_bucket_is_cut_by_a_second_hash(make_points):
    rng = np.random.default_rng(2)
    points = make_points(rng.normal(size=(400, 2)).tolist(), partitions=3)
    with pytest.raises(PySparkException, match="subdivide"):
        C.partition_kmeans(points, 3, n_buckets=2, group_rows=90).collect()
    found = C.partition_kmeans(points, 3, n_buckets=2, group_rows=90, subdivide=True).orderBy("bucket")
    rows = found.collect()
    assert sum(r.record_count for r in rows) == sum(r.distinct_keys for r in rows) == 400
    assert len(rows) > 4 and {r.bucket % (1 << 31) for r in rows} == {0, 1}
    again = C.partition_kmeans(points.repartition(5), 3, n_buckets=2, group_rows=90, subdivide=True).orderBy("bucket")
    assert again.collect() == rows
