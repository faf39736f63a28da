import numpy as np
import pytest
from pyspark.sql import functions as F

from centroidal.operators import generate as G


@pytest.mark.parametrize("rows, k", [(1000, 5), (11, 3), (7, 7)])
def test_sizes_are_balanced_and_the_remainder_goes_first(spark, rows, k):
    points, _ = G.diagonal_blobs(spark, rows, 2, k, partitions=3)
    found = {r.label: r.n for r in points.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert found == {j: rows // k + (j < rows % k) for j in range(k)}
    assert [r.label for r in points.orderBy("record_id").collect()] == sorted(j for j, n in found.items() for _ in range(n))


def test_zero_spread_lies_on_the_centers(spark):
    points, centers = G.diagonal_blobs(spark, 20, 3, 4, spread=0.0, separation=5.0)
    by_cluster = {r.cluster: r.center for r in centers.collect()}
    assert by_cluster[2] == [10.0, 11.0, 12.0]
    assert all(r.features == by_cluster[r.label] for r in points.collect())


def test_tables_do_not_depend_on_partitioning_but_on_the_seed(spark):
    def table(seed, partitions):
        points, _ = G.diagonal_blobs(spark, 100, 3, 4, seed=seed, partitions=partitions)
        return points.orderBy("record_id").collect()

    assert table(1, 1) == table(1, 6) != table(2, 1)


def test_noise_is_standard_normal(spark):
    points, _ = G.diagonal_blobs(spark, 40_000, 4, 1, spread=2.0)
    values = np.array([r.features for r in points.collect()]) - np.arange(4)
    assert np.allclose(values.mean(0), 0, atol=0.05) and np.allclose(values.std(0), 2, atol=0.05)
    assert np.abs(np.corrcoef(values.T) - np.eye(4)).max() < 0.03
    assert abs((values**3).mean()) < 0.3 and (np.abs(values) < 4).mean() == pytest.approx(0.954, abs=0.01)


def test_every_prefix_is_class_balanced(spark):
    points, centers = G.uniform_blobs(spark, 5000, 20, 5)
    labels = [r.label for r in points.orderBy("record_id").collect()]
    assert np.bincount(labels).tolist() == [1000] * 5
    assert np.bincount(labels[:500]).tolist() == [100] * 5
    assert len(set(map(tuple, np.reshape(labels, (-1, 5)).tolist()))) > 1
    corners = np.array([r.center for r in centers.collect()])
    assert corners.shape == (5, 20) and np.abs(corners).max() <= 10


def test_size_ladder(spark):
    ladder = G.size_ladder(spark, [100, 1000], 3, 5)
    found = ladder.groupBy("size").agg(F.count("*").alias("n"), F.stddev_pop("f0").alias("s")).orderBy("size").collect()
    assert [(r["size"], r.n) for r in found] == [(100, 100), (1000, 1000)]
    assert all(r.s == pytest.approx(1) for r in found)


@pytest.mark.parametrize(
    "options",
    [
        {"rows": 0}, {"dimensions": 0}, {"k": 0}, {"rows": 3, "k": 4}, {"spread": -1.0}, {"spread": float("inf")},
        {"separation": 0.0}, {"separation": float("nan")},
    ],
)
def test_bad_arguments(spark, options):
    with pytest.raises(ValueError):
        G.diagonal_blobs(spark, **{"rows": 10, "dimensions": 2, "k": 2, **options})
