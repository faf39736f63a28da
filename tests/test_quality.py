import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from centroidal.operators import quality as Q
from centroidal.operators.assign import assign


def pairs(spark, labels, clusters, kind="bigint"):
    return spark.createDataFrame(list(zip(labels, clusters)), f"label {kind}, cluster bigint").repartition(2)


def brute_force(labels, clusters):
    """Pair counting for ARI, probabilities for NMI."""
    n = len(labels)
    same = [(labels[i] == labels[j], clusters[i] == clusters[j]) for i in range(n) for j in range(i + 1, n)]
    tp, fn = same.count((True, True)), same.count((True, False))
    fp, tn = same.count((False, True)), same.count((False, False))
    if fn == fp == 0:
        ari = 1.0
    else:
        ari = 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    _, a = np.unique(labels, return_inverse=True)
    _, b = np.unique(clusters, return_inverse=True)
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    p, pa, pb = table / n, table.sum(1) / n, table.sum(0) / n
    ha, hb = -(pa * np.log(pa)).sum(), -(pb * np.log(pb)).sum()
    mi = sum(p[i, j] * math.log(p[i, j] / pa[i] / pb[j]) for i, j in zip(*np.nonzero(p)))
    nmi = 1.0 if ha == hb == 0 else 0.0 if mi <= 1e-12 else mi / ((ha + hb) / 2)
    return ari, nmi, table.max(0).sum() / n


@pytest.mark.parametrize(
    "labels, clusters, wanted",
    [
        ([0, 0, 1, 1], [0, 0, 1, 1], (1, 1, 1)),
        ([0, 0, 1, 1], [9, 9, 4, 4], (1, 1, 1)),
        ([0, 0, 1, 1], [0, 1, 0, 1], (-0.5, 0, 0.5)),
        ([0, 0, 0], [1, 1, 1], (1, 1, 1)),
        ([0, 1, 2], [5, 6, 7], (1, 1, 1)),
        ([0, 0, 1, 1], [3, 3, 3, 3], (0, 0, 0.5)),
        ([7], [7], (1, 1, 1)),
    ],
)
def test_known_cases(spark, labels, clusters, wanted):
    row = Q.evaluate_quality(pairs(spark, labels, clusters)).first()
    assert (row.ari, row.nmi, row.purity) == pytest.approx(wanted)
    assert (row.num_records, row.num_classes, row.num_clusters) == (len(labels), len(set(labels)), len(set(clusters)))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3)), min_size=2, max_size=40))
def test_against_brute_force(spark, rows):
    labels, clusters = [list(side) for side in zip(*rows)]
    row = Q.evaluate_quality(pairs(spark, labels, clusters)).first()
    assert (row.ari, row.nmi, row.purity) == pytest.approx(brute_force(labels, clusters), abs=1e-9)


def test_text_labels(spark):
    row = Q.evaluate_quality(pairs(spark, ["normal", "normal", "attack", "attack"], [1, 1, 0, 0], "string")).first()
    assert row.purity == 1


def test_invalid_input(spark):
    with pytest.raises(PySparkException, match="empty"):
        Q.evaluate_quality(pairs(spark, [], [])).collect()
    for metric in (Q.purity, Q.adjusted_rand_index, Q.normalized_mutual_information, Q.cardinalities):
        with pytest.raises(PySparkException, match="empty"):
            metric(pairs(spark, [], [])).collect()
    with pytest.raises(PySparkException, match="null"):
        Q.evaluate_quality(pairs(spark, [0, None], [0, 1])).collect()
    with pytest.raises(ValueError, match="integers or strings"):
        Q.contingency(pairs(spark, [0.5], [0], "double"))


def test_large_counts_do_not_overflow(spark):
    cells = spark.createDataFrame([(0, 0, 4 * 10**12), (1, 1, 4 * 10**12)], "label bigint, cluster bigint, n bigint")
    row = Q.quality_row(cells).first()
    assert (row.ari, row.nmi, row.purity) == pytest.approx((1, 1, 1))


def test_metrics_scan_the_table_once(spark):
    plan = Q.evaluate_quality(pairs(spark, [0, 1], [0, 1]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") == 1


def test_cross_check(spark, make_points):
    points = make_points([(0, 0), (1, 0), (10, 10), (11, 10)])
    good = Q.run_fingerprint(assign(points, [(0, 0), (10, 10)]), 2)
    assert all(Q.cross_check(good, good).first())
    moved = Q.run_fingerprint(assign(points, [(0, 0.5), (10, 10)]), 2)
    row = Q.cross_check(good, moved).first()
    assert row.same_cluster_counts and not row.same_sse and not row.agree
    close = good.withColumn("sse", F.col("sse") * (1 + 1e-8))
    assert Q.cross_check(good, close).first().agree


def test_cross_check_compares_cluster_numbers(spark):
    def print_of(sizes):
        rows = [([0.0], c, 1.0) for c, n in sizes.items() for _ in range(n)]
        return Q.run_fingerprint(spark.createDataFrame(rows, "features array<double>, cluster int, distance_sq double"), 5)

    assert print_of({0: 2, 1: 1}).first().cluster_counts == [2, 1, 0, 0, 0]
    row = Q.cross_check(print_of({0: 2, 1: 1}), print_of({0: 2, 4: 1})).first()
    assert row.same_sse and row.same_clusters and not row.same_cluster_counts and not row.agree
