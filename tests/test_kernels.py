import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from centroidal.functions.kernels import (
    Statistics,
    _nearest_direct,
    _settle,
    fit_group,
    max_shift,
    means_of,
    nearest,
    race_seeds,
    sums_by,
    to_matrix,
)
from centroidal.functions.keys import uniform_array
from tests.fixtures import TWO_BLOBS


def keys_for(n, start=0):
    rng = np.random.default_rng(start)
    return rng.integers(0, 1 << 56, n)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 40), st.integers(2, 20), st.integers(0, 1000), st.booleans())
def test_matrix_product_path_equals_direct_formula(n, k, d, seed, on_grid):
    rng = np.random.default_rng(seed)
    points, centers = rng.normal(size=(n, d)), rng.normal(size=(k, d))
    if on_grid:  # many exact ties
        points, centers = np.round(points), np.round(centers)
    labels, distances = nearest(points, centers)
    wanted_labels, wanted = _nearest_direct(points, centers)
    assert (labels == wanted_labels).all()
    assert (distances == wanted).all()


def test_far_offset_does_not_change_the_choice():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(500, 16)) + 1e7
    centers = rng.normal(size=(20, 16)) + 1e7
    assert (nearest(points, centers)[0] == _nearest_direct(points, centers)[0]).all()


def test_tie_goes_to_lowest_index():
    labels, distances = nearest(np.array([[1.0, 0.0]]), np.array([[0.0, 0.0], [2.0, 0.0]]))
    assert labels[0] == 0 and distances[0] == 1.0


def test_dimension_mismatch_is_rejected():
    with pytest.raises(ValueError):
        nearest(np.zeros((2, 3)), np.zeros((1, 2)))


def test_statistics_merge_like_a_sum_and_keep_empty_clusters():
    points, centers = np.array([[0.0, 0.0], [2.0, 0.0]]), np.array([[0.0, 0.0], [9.0, 9.0]])
    statistics = Statistics.empty(2, 2)
    for row in points:
        statistics.add(row[None], *nearest(row[None], centers))
    assert statistics.counts.tolist() == [2, 0]
    assert statistics.sse.tolist() == [4.0, 0.0]
    assert statistics.means(centers).tolist() == [[1.0, 0.0], [9.0, 9.0]]


def test_max_shift_is_squared_and_checks_shapes():
    assert max_shift(np.array([[0.0, 0.0]]), np.array([[3.0, 4.0]])) == 25.0
    with pytest.raises(ValueError):
        max_shift(np.zeros((1, 2)), np.zeros((2, 2)))
    with pytest.raises(ValueError):
        max_shift(np.zeros((0, 2)), np.zeros((0, 2)))


def test_two_blobs():
    fit = fit_group(np.array(TWO_BLOBS), keys_for(6), 2, 100, 1e-6, 7)
    assert fit.converged
    assert sorted(map(tuple, fit.centers.round(9).tolist())) == [(1.0, 1.0), (9.0, 9.0)]
    assert fit.sse == pytest.approx(0.08)
    assert sorted(fit.counts) == [3, 3]


def test_same_seed_same_fit_and_row_order_is_irrelevant():
    points = np.array([(i, i) for i in range(20)], dtype=float)
    keys = keys_for(20)
    first = fit_group(points, keys, 3, 100, 1e-6, 5)
    order = np.random.default_rng(1).permutation(20)
    second = fit_group(points[order], keys[order], 3, 100, 1e-6, 5)
    assert (first.centers == second.centers).all() and first.sse == second.sse


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(1, 8), st.integers(1, 6), st.integers(0, 1000), st.booleans(), st.sampled_from([0, 1e6]))
def test_skipping_settled_points_changes_nothing(n, k, d, seed, on_grid, offset):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, d)) * 3 + offset
    if on_grid:
        points = np.round(points)
    centers = points[rng.integers(0, n, k)].copy()
    fit = _settle(points, centers, 30, 0.0)
    for _ in range(fit.iterations):
        labels = _nearest_direct(points, centers)[0]
        centers = means_of(np.bincount(labels, minlength=k), sums_by(labels, points, k), centers)
    labels, distances = _nearest_direct(points, centers)
    assert (fit.centers == centers).all()
    assert (fit.counts == np.bincount(labels, minlength=k)).all()
    assert fit.sse == pytest.approx(distances.sum())


def test_iteration_limit_reports_not_converged():
    points = np.random.default_rng(0).normal(size=(200, 2))
    fit = fit_group(points, keys_for(200), 5, 1, 0.0, 1)
    assert fit.iterations == 1 and not fit.converged


def test_identical_rows_are_seeded_once_each():
    points = np.zeros((5, 2))
    assert race_seeds(points, keys_for(5), 5, 1).shape == (5, 2)


def test_seeding_follows_the_squared_distance_law():
    # From a first seed at 0 the next is 1 with weight 1 and 3 with weight 9.
    points = np.array([[0.0], [1.0], [3.0]])
    hits = {1.0: 0, 3.0: 0}
    for seed in range(4000):
        seeds = race_seeds(points, keys_for(3, 0), 2, seed)
        if seeds[0, 0] == 0.0:
            hits[float(seeds[1, 0])] += 1
    total = sum(hits.values())
    assert total > 1000
    assert hits[3.0] / total == pytest.approx(0.9, abs=0.03)


def test_uniforms_are_uniform_and_draws_uncorrelated():
    keys = keys_for(50_000)
    first, second = uniform_array(keys, 42, 1), uniform_array(keys, 42, 2)
    assert 0 < first.min() and first.max() <= 1
    assert first.mean() == pytest.approx(0.5, abs=0.01)
    assert np.histogram(first, 10, (0, 1))[0].min() > 4500
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.02


@pytest.mark.parametrize(
    "column",
    [
        pa.array([[1.0], [1.0, 2.0]], pa.list_(pa.float64())),
        pa.array([[1.0], None], pa.list_(pa.float64())),
        pa.array([[1.0], [None]], pa.list_(pa.float64())),
        pa.array([[], []], pa.list_(pa.float64())),
    ],
)
def test_malformed_vectors_are_rejected(column):
    with pytest.raises(ValueError):
        to_matrix(column)


def test_sliced_arrow_columns_convert():
    column = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], pa.list_(pa.float64())).slice(1, 2)
    assert to_matrix(column).tolist() == [[3.0, 4.0], [5.0, 6.0]]
    chunked = pa.chunked_array([column, column])
    assert to_matrix(chunked).shape == (4, 2)
