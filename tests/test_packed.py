"""Packed blocks: the rows of points as they are, read once for all rounds."""

import numpy as np
import pytest

from centroidal.functions.kernels import _nearest_direct, nearest
from centroidal.operators import lloyd as L
from centroidal.operators import local as C
from centroidal.operators import packed as P
from centroidal.operators.seeding import kmeanspp_seeds
from centroidal.plans.clustering import parallel_kmeans

RNG = np.random.default_rng(5)
ROWS = RNG.normal(size=(400, 3)) + RNG.integers(0, 4, size=(400, 1)) * 3.0


def counted(points, reads):
    """The points, and an accumulator that counts how often a row of them is read."""

    def run(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return points.mapInArrow(run, points.schema)


def test_blocks_hold_the_rows_in_order(make_points, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 7 * 24)
    points = make_points(ROWS, partitions=3)
    wanted = P.keyed(points).collect()
    found = P.pack(P.keyed(points)).collect()
    assert max(len(r["block"]) for r in found) == 7 * 24
    assert np.concatenate([np.frombuffer(r["keys"], np.int64) for r in found]).tolist() == [r["key"] for r in wanted]
    assert np.concatenate([np.frombuffer(r["block"]) for r in found]).tolist() == [v for r in wanted for v in r["features"]]


def test_rounds_read_the_points_once(make_points, spark):
    reads = spark.sparkContext.accumulator(0)
    fit = L.lloyd_fit(counted(make_points(ROWS, partitions=3), reads), ROWS[:4], tolerance=0.0)
    assert fit.iterations > 2 and reads.value == len(ROWS)
    plain = make_points(ROWS, partitions=3)
    history, converged = L.iterate(plain, ROWS[:4], 100, 0.0)
    assert np.allclose(history[-1].centers, fit.centers, rtol=1e-12, atol=1e-12)
    assert L.finish(plain, history, converged).sse == pytest.approx(fit.sse, rel=1e-12)


def test_distributed_seeds_read_the_points_once(make_points, spark):
    reads = spark.sparkContext.accumulator(0)
    points = make_points(ROWS, partitions=3)
    found = C.fit_seeds(counted(points, reads), 4, [1, 2], rows=len(ROWS), dimensions=3, distributed=True)
    assert reads.value == len(ROWS) and [f.seed for f in found] == [1, 2]
    plain = C._fit_seeds_distributed(points, 4, [1, 2], 100, 1e-6)
    assert [np.allclose(f.centers, p.centers, rtol=1e-12, atol=1e-12) for f, p in zip(found, plain)] == [True, True]


def test_many_draws_from_packed_points(make_points):
    points = make_points(ROWS, partitions=2)
    with P.packed(points, with_keys=True) as blocks:
        assert (kmeanspp_seeds(blocks, 40, [3, 4]) == kmeanspp_seeds(points, 40, [3, 4])).all()


def test_small_partitions_are_put_together(make_points, spark):
    many = 10 * spark.sparkContext.defaultParallelism
    points = make_points(ROWS, partitions=many)
    with P.packed(points, rows=len(ROWS), dimensions=3) as blocks:
        assert blocks.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    with P.packed(points) as blocks:
        assert blocks.rdd.getNumPartitions() == many
    reads = spark.sparkContext.accumulator(0)
    model = parallel_kmeans(counted(points, reads), 2, n_buckets=3)
    assert reads.value == 2 * len(ROWS) and sum(model.cluster_counts) == len(ROWS)
    model.release()


def test_a_table_with_a_column_named_block_is_not_packed(make_points):
    points = make_points(ROWS).selectExpr("*", "1 AS block", "2 AS width")
    assert not P.is_packed(points)
    assert L.lloyd_step(points, ROWS[:2]).counts == L.lloyd_step(make_points(ROWS), ROWS[:2]).counts


@pytest.mark.parametrize("k", [1, 2, 5, 20])
def test_labels_are_those_of_direct_measuring(k):
    centers = np.round(RNG.normal(size=(k, 3)), 1)
    rows = np.round(RNG.normal(size=(5000, 3)), 1)  # many exact ties
    direct = ((rows[:, None, :] - centers[None]) ** 2).sum(axis=2)
    labels, distances = nearest(rows, centers)
    assert (labels == _nearest_direct(rows, centers)[0]).all() and np.allclose(distances, direct.min(axis=1))
