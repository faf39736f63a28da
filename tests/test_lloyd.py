import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from centroidal.operators import lloyd as L
from centroidal.operators.assign import assign, centers_frame
from tests.fixtures import EMPTY, SQUARES, STEP


def test_step_moves_measures_and_counts(make_points):
    step = L.lloyd_step(make_points(STEP, partitions=2), [(0, 0), (10, 10)])
    assert step.centers.round(9).tolist() == [[1.0, 1.0], [9.0, 9.0]]
    assert step.counts == (4, 4)
    assert step.sse == pytest.approx(16.32)
    assert step.max_center_shift == pytest.approx(2.0)


def test_empty_cluster_keeps_its_center(make_points):
    step = L.lloyd_step(make_points(EMPTY), [(0, 0), (100, 100)])
    assert step.centers.round(9).tolist() == [[0.1, 0.1], [100.0, 100.0]]
    assert step.counts == (4, 0)


def test_step_composed_from_its_parts_gives_the_same(make_points, spark):
    points, start = make_points(STEP, partitions=3), [(0, 0), (10, 10), (50, 50)]
    kept = L.keep_empty(L.cluster_means(assign(points, start)), start).orderBy("cluster")
    step = L.lloyd_step(points, start)
    assert np.allclose([r.center for r in kept.collect()], step.centers)
    assert [r.n for r in kept.collect()] == list(step.counts)
    shift = L.max_center_shift(centers_frame(spark, start), kept).first().max_center_shift
    assert shift == pytest.approx(step.max_center_shift)


def test_cluster_statistics_add_up(make_points):
    rows = L.cluster_statistics(make_points(STEP, partitions=3), [(1, 1), (9, 9)]).orderBy("cluster").collect()
    assert [r.n for r in rows] == [4, 4]
    assert np.allclose([r.sums for r in rows], [[4, 4], [36, 36]])
    assert [r.sse for r in rows] == pytest.approx([0.16, 0.16])


def test_shift_requires_matching_centers(spark):
    one, two = centers_frame(spark, [(0, 0)]), centers_frame(spark, [(0, 0), (1, 1)])
    with pytest.raises(PySparkException, match="match"):
        L.max_center_shift(one, two).collect()
    with pytest.raises(PySparkException, match="at least one"):
        L.max_center_shift(one.where("cluster < 0"), one.where("cluster < 0")).collect()


@pytest.mark.parametrize("tolerance", [0.0, 1e12])
def test_one_round_never_converges(make_points, tolerance):
    fit = L.lloyd_fit(make_points(SQUARES), [(1, 1), (9, 9)], max_iterations=1, tolerance=tolerance)
    assert (fit.iterations, fit.converged, len(fit.history)) == (1, False, 1)


def test_stops_on_error_change_although_centers_still_move(make_points):
    # A huge tolerance accepts the second round whatever the centres do.
    fit = L.lloyd_fit(make_points(SQUARES), [(0, 0), (0, 1)], max_iterations=10, tolerance=1e12)
    assert fit.converged and fit.iterations == 2
    assert fit.history[-1].max_center_shift > 0


def test_final_measures_belong_to_the_returned_centers(make_points):
    fit = L.lloyd_fit(make_points(SQUARES), [(0, 0), (10, 10)], max_iterations=1)
    assert fit.history[0].sse > fit.sse == pytest.approx(16.0)
    assert fit.cluster_counts == (4, 4)


def test_settled_round_saves_the_final_scan(make_points, monkeypatch):
    def forbidden(*_):
        raise AssertionError("no further scan is needed")

    monkeypatch.setattr(L, "measure_centers", forbidden)
    fit = L.lloyd_fit(make_points(SQUARES), [(1, 1), (9, 9)])
    assert fit.converged and fit.sse == pytest.approx(16.0)


def test_history_frame(make_points, spark):
    fit = L.lloyd_fit(make_points(SQUARES), [(0, 0), (10, 10)])
    rows = fit.history_frame(spark).orderBy("iteration").collect()
    assert [r.iteration for r in rows] == list(range(1, fit.iterations + 1))
    assert all(sum(r.cluster_counts) == 8 for r in rows)
    errors = [r.sse for r in rows]
    assert errors == sorted(errors, reverse=True)


def test_fixed_rounds(make_points):
    fit = L.lloyd_fit(make_points(SQUARES), [(1, 1), (9, 9)], max_iterations=4, tolerance=None)
    assert fit.iterations == 4 and not fit.converged


@pytest.mark.parametrize("options", [{"max_iterations": 0}, {"tolerance": -1.0}, {"tolerance": float("nan")}])
def test_bad_arguments(make_points, options):
    with pytest.raises(ValueError):
        L.lloyd_fit(make_points(SQUARES), [(0, 0)], **options)


def test_empty_and_nonfinite_tables(make_points):
    with pytest.raises(ValueError, match="empty"):
        L.lloyd_fit(make_points([]), [(0, 0)])
    with pytest.raises(ValueError, match="NaN"):
        L.lloyd_step(make_points([(0, float("nan"))]), [(0, 0)])
    with pytest.raises(ValueError):
        L.lloyd_step(make_points(SQUARES), [])
    with pytest.raises(PySparkException, match="features but centers"):
        L.lloyd_step(make_points(SQUARES), [(0, 0, 0)])


def test_stopping_rule_is_the_plain_tolerance():
    for error in (1.0, 1e6, 1e13):
        assert not L._settled(error, error + 0.25, 0.2) and L._settled(error, error + 0.25, 0.25)
    assert L._settled(1e13, 1e13 + 1e-2, 0.0, relative=1e-12)


def test_stops_by_tolerance_before_the_limit(make_points):
    points = make_points(SQUARES, partitions=2)
    model = L.lloyd_fit(points, [(0, 0), (8, 8)], max_iterations=50, tolerance=0.25)
    errors = [s.sse for s in model.history]
    assert model.converged and 1 < model.iterations < 50
    assert abs(errors[-1] - errors[-2]) <= 0.25 and all(abs(b - a) > 0.25 for a, b in zip(errors[:-2], errors[1:-1]))
    assert not L.lloyd_fit(points, [(0, 0), (8, 8)], max_iterations=1, tolerance=1e12).converged


def test_several_models_share_one_scan(make_points):
    points = make_points(STEP, partitions=2)
    models = np.array([[(0.0, 0.0), (10.0, 10.0)], [(1.0, 1.0), (9.0, 9.0)]])
    both = L.gather_statistics(points, models)
    for model, found in zip(models, both):
        single = L.gather_statistics(points, model[None])[0]
        assert (single.counts == found.counts).all() and np.allclose(single.sums, found.sums)


def test_answers_are_never_read(spark, make_points, tmp_path):
    path = str(tmp_path.parent / "with_answers")
    make_points(STEP, list(range(8))).write.parquet(path)
    plan = L.partial_statistics(spark.read.parquet(path), np.zeros((1, 1, 2)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<features:array<double>>" in text and "label" not in text


def test_cluster_means_of_given_ids(make_points):
    frame = make_points(STEP, [3] * 4 + [8] * 4)
    rows = L.cluster_means(frame, "label").orderBy("cluster").collect()
    assert [(r.cluster, r.n) for r in rows] == [(3, 4), (8, 4)]
    assert np.allclose([r.center for r in rows], [[1, 1], [9, 9]])
    assert frame.where(F.col("label") > 99).transform(lambda d: L.cluster_means(d, "label")).count() == 0


def test_the_last_exchange_moves_one_row_per_slot_and_cluster(make_points, monkeypatch):
    """Partial rows carry whole vectors and are added for FAN_IN tasks at a time, then by cluster."""
    monkeypatch.setattr(L, "FAN_IN", 4)
    points = make_points([(float(i % 7), float(i % 5)) for i in range(240)], partitions=12)
    centers = np.array([(0.0, 0.0), (3.0, 3.0), (6.0, 1.0)])
    found = L.cluster_statistics(points, centers)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(slot" in plan and "hashpartitioning(cluster" in plan and "dim" not in plan

    rows = {r.cluster: r for r in found.collect()}
    block = np.array([(float(i % 7), float(i % 5)) for i in range(240)])
    nearest = ((block[:, None] - centers) ** 2).sum(axis=2)
    labels = nearest.argmin(axis=1)
    assert {c: r.n for c, r in rows.items()} == dict(enumerate(np.bincount(labels).tolist()))
    for c, r in rows.items():
        assert np.allclose(r.sums, block[labels == c].sum(axis=0)) and r.sse == pytest.approx(nearest[labels == c, c].sum())


def test_added_rows_do_not_depend_on_their_order():
    rng = np.random.default_rng(3)
    part, cluster = np.repeat(np.arange(40), 3), np.tile(np.arange(3), 40)
    sums = rng.normal(size=(120, 5)) * 1e6
    rows = [L._partial_batch(int(p), int(p) // 4, np.array([c]), np.array([2]), np.array([0.1 * p]), s[None]) for p, c, s in zip(part, cluster, sums)]
    results = []
    for order in (range(120), rng.permutation(120).tolist()):
        (slots,) = L._adder(True)(iter([rows[i] for i in order]))
        assert slots.num_rows == 30  # ten slots, three clusters
        (whole,) = L._adder(False)(iter([slots.take(pa.array(rng.permutation(30)))]))
        results.append(whole)
    assert results[0].equals(results[1]) and results[0].column("n").to_pylist() == [80] * 3
    assert np.allclose(np.array(results[0].column("sums").to_pylist()), [sums[cluster == c].sum(axis=0) for c in range(3)])
    assert list(L._adder(True)(iter([]))) == []


def test_few_slots_are_added_by_the_driver_with_the_same_sums(make_points, monkeypatch):
    rng = np.random.default_rng(5)
    points = make_points((rng.normal(size=(200, 3)) * 1e5).tolist(), partitions=6)
    models = rng.normal(size=(2, 3, 3)) * 1e5
    monkeypatch.setattr(L, "FAN_IN", 2)
    layout = L.Layout()
    first = L.gather_statistics(points, models, layout=layout)
    assert layout.slots == 3
    second = L.gather_statistics(points, models, layout=layout)
    monkeypatch.setattr(L, "DRIVER_SLOTS", 2)
    third = L.gather_statistics(points, models, layout=layout)
    for a, b, c in zip(first, second, third):
        assert a.sums.tolist() == b.sums.tolist() == c.sums.tolist() and a.sse.tolist() == b.sse.tolist() == c.sse.tolist()
    with pytest.raises(ValueError, match="empty"):
        L.gather_statistics(points.limit(0), models, layout=L.Layout(1))
