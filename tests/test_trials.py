import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from centroidal.operators import trials as T
from centroidal.plans.experiments import run_trials
from centroidal.sources.readers import read_quality_table
from tests.fixtures import TWELVE
from tests.test_sources import HEADER, trial

# Own measurements of two datasets: the quality and seconds of a base run, of one with more cores, and of a single process.
RUNS = [
    ("rings", "parallel_kmeans", "local[1]", 600, 3, 4, 250.5, 0.9, 0.8, 0.7, "150;150;200;100", 3.2, 7, True),
    ("rings", "parallel_kmeans", "local[2]", 600, 3, 4, 250.5, 0.9, 0.8, 0.7, "150;150;200;100", 2.0, 7, True),
    ("flows", "parallel_kmeans", "local[1]", 900, 6, 3, 80.25, 0.6, 0.25, 0.3, "300;500;100", 4.5, 9, True),
    ("rings", "traditional_kmeans", "single_process", 600, 3, 4, 249.0, 0.95, 0.85, 0.75, "200;150;150;100", 1.1, 6, True),
    ("flows", "traditional_kmeans", "single_process", 900, 6, 3, 75.0, 0.7, 0.5, 0.4, "450;350;100", 1.4, 5, True),
]
BODY = "".join(",".join(map(str, run)) + "\n" for run in RUNS)


def quality(spark, tmp_path, body):
    path = tmp_path / "quality.csv"
    path.write_text(HEADER + body)
    return read_quality_table(spark, str(path))


def test_summary_means_and_sample_deviations(spark):
    times = [2.0, 3.0, 7.0]
    rows = trial(spark, total_runtime_seconds=times[0])
    for i, t in enumerate(times[1:]):
        rows = rows.union(trial(spark, total_runtime_seconds=t, converged=i == 0))
    row = T.summarize_trials(rows, ["dataset_name"]).first()
    assert (row.repetitions, row.converged_runs) == (3, 2)
    assert row.convergence_rate == pytest.approx(2 / 3)
    assert row.mean_total_runtime_seconds == pytest.approx(4.0)
    assert row.std_total_runtime_seconds == pytest.approx(statistics.stdev(times))
    assert row.std_sse == 0.0 and row.mean_iterations == 3.0
    assert T.convergence_rate(rows, ["dataset_name"]).first().convergence_rate == pytest.approx(2 / 3)


def test_single_run_has_zero_deviation(spark):
    row = T.summarize_trials(trial(spark), ["dataset_name"]).first()
    assert row.std_total_runtime_seconds == 0.0 and row.repetitions == 1


def test_speedup(spark):
    rows = [(10, "local[1]", 8.0), (10, "local[4]", 4.0), (50, "local[1]", 100.0), (50, "local[4]", 0.0), (99, "local[4]", 1.0)]
    summary = spark.createDataFrame(rows, "num_records int, spark_master string, mean_total_runtime_seconds double")
    found = T.speedup(summary, size="num_records", configuration="spark_master", base="local[1]")
    by_key = {(r.num_records, r.spark_master): (r.speedup, r.runtime_reduction_percent) for r in found.collect()}
    assert by_key[(10, "local[4]")] == pytest.approx((2.0, 50.0))
    assert by_key[(10, "local[1]")] == pytest.approx((1.0, 0.0))
    assert by_key[(50, "local[4]")] == (None, None) and by_key[(99, "local[4]")] == (None, None)


def test_quality_comparison(spark, tmp_path):
    rows = {r.dataset: r for r in T.quality_comparison(quality(spark, tmp_path, BODY)).collect()}
    assert set(rows) == {"rings", "flows"}
    assert rows["rings"].speedup == pytest.approx(3.2 / 2.0)
    assert rows["flows"].comparison_master is None and rows["flows"].speedup is None
    assert rows["flows"].purity_gap == pytest.approx(0.6 - 0.7)
    assert rows["flows"].ari_gap == pytest.approx(0.25 - 0.5)


@pytest.mark.parametrize("dropped", ["flows,parallel_kmeans,local[1]", "flows,traditional_kmeans"])
def test_missing_role_is_rejected(spark, tmp_path, dropped):
    body = "".join(line + "\n" for line in BODY.splitlines() if not line.startswith(dropped))
    with pytest.raises(PySparkException, match="dataset flows needs one base"):
        T.quality_comparison(quality(spark, tmp_path, body)).collect()


def test_repeated_role_is_rejected(spark, tmp_path):
    table = quality(spark, tmp_path, BODY)
    for role in (F.col("algorithm") == "traditional_kmeans", F.col("master") == "local[1]", F.col("master") == "local[2]"):
        with pytest.raises(PySparkException, match="needs one base"):
            T.quality_comparison(table.union(table.where(role))).collect()


def test_zero_time_gives_no_speedup(spark, tmp_path):
    rows = T.quality_comparison(quality(spark, tmp_path, BODY.replace(",2.0,7,", ",0,7,"))).collect()
    assert all(r.speedup is None for r in rows)


def test_repeated_runs_become_trial_rows(make_points):
    points = make_points(TWELVE)
    rows = run_trials(points, 2, dataset_name="pairs", repetitions=3, warmups=1, n_buckets=1)
    found = rows.orderBy("random_seed").collect()
    assert [r.random_seed for r in found] == [42, 43, 44]
    assert len({r.experiment_id for r in found}) == 3
    assert all(r.converged and sorted(r.cluster_counts) == [6, 6] and r.num_records == 12 for r in found)
    assert all(r.total_runtime_seconds >= r.initialization_seconds > 0 for r in found)
    assert T.summarize_trials(rows, ["dataset_name"]).first().repetitions == 3
    for bad in ({"repetitions": 0}, {"warmups": -1}, {"dataset_name": " "}, {"local_tolerance": float("inf")}):
        with pytest.raises(ValueError):
            run_trials(points, 2, **{"dataset_name": "d", "repetitions": 1, "n_buckets": 1, **bad})
