import pytest
from pyspark.sql import functions as F

from centroidal.functions.keys import salted_key
from centroidal.operators import points as P


def test_summary_of_valid_points(make_points):
    summary = P.validate_points(
        make_points([(0, 1), (2, 3)], [4, 5]), label="label", expected_rows=2, expected_features=2, expected_classes=2
    )
    assert summary == {"name": "points", "rows": 2, "features": 2, "classes": 2}


@pytest.mark.parametrize(
    "vectors, options",
    [
        ([], {}),
        ([(0, 1), (2,)], {}),
        ([()], {}),
        ([(0, float("nan"))], {}),
        ([(0, float("inf"))], {}),
        ([(0, float("-inf"))], {}),
        ([(0, 1)], {"expected_rows": 2}),
        ([(0, 1)], {"expected_features": 3}),
    ],
)
def test_invalid_points(make_points, vectors, options):
    with pytest.raises(ValueError):
        P.validate_points(make_points(vectors), **options)


def test_labels_are_checked(make_points):
    with pytest.raises(ValueError, match="labels"):
        P.validate_points(make_points([(0,), (1,)], [1, None]), label="label")
    with pytest.raises(ValueError, match="classes"):
        P.validate_points(make_points([(0,), (1,)], [1, 1]), label="label", expected_classes=2)


def test_null_values_and_vectors_are_counted(spark):
    rows = [(1, None), (2, [None, 1.0]), (3, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "record_id bigint, features array<double>")
    assert P.points_summary(frame).first().invalid_rows == 2


def test_histogram(make_points):
    found = P.class_histogram(make_points([(0,)] * 3, ["a", "b", "a"])).collect()
    assert {r.label: r.rows for r in found} == {"a": 2, "b": 1}


def test_ids_follow_partitions(spark):
    frame = spark.range(100, numPartitions=7).withColumnRenamed("id", "v")
    rows = P.assign_record_id(frame).orderBy("record_id").collect()
    assert [(r.record_id, r.v) for r in rows] == [(i, i) for i in range(100)]


def test_ids_with_empty_partitions(spark):
    frame = spark.range(100, numPartitions=7).where("id % 40 = 0").withColumnRenamed("id", "v")
    assert [r.record_id for r in P.assign_record_id(frame).orderBy("v").collect()] == [0, 1, 2]


def test_ids_follow_an_order_even_when_one_key_dominates(spark):
    frame = spark.range(3000, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") * 17 % 3000).alias("v")
    )
    rows = P.assign_record_id(frame, ["k", "v"]).orderBy("record_id").collect()
    assert [r.record_id for r in rows] == list(range(3000))
    assert [(r.k, r.v) for r in rows] == sorted((r.k, r.v) for r in rows)


@pytest.mark.parametrize("n", [1, 37, 500, 999, 1000, 5000])
def test_exact_sample_is_the_smallest_hashes(spark, n):
    frame = spark.range(1000).withColumnRenamed("id", "record_id")
    sample = P.exact_sample(frame, n, 7)
    hashed = frame.withColumn("h", salted_key(F.col("record_id"), 7)).orderBy("h", "record_id").limit(n)
    assert {r[0] for r in sample.collect()} == {r[0] for r in hashed.select("record_id").collect()}
    assert sample.columns == ["record_id"]


def test_sample_keeps_the_scan_and_repeats(spark):
    frame = spark.range(1000).withColumnRenamed("id", "record_id")
    sample = P.exact_sample(frame, 10)
    assert "Exchange" not in sample._jdf.queryExecution().executedPlan().toString()
    ids = [r[0] for r in sample.collect()]
    assert ids == sorted(ids) == [r[0] for r in P.exact_sample(frame, 10).collect()]
    assert set(ids) != {r[0] for r in P.exact_sample(frame, 10, seed=1).collect()}


def test_sample_of_text_ids(spark):
    frame = spark.range(200).select(F.concat(F.lit("r"), "id").alias("record_id"))
    assert P.exact_sample(frame, 20).count() == 20


@pytest.mark.parametrize("n", [1, 100, 400, 1500])
def test_sample_is_exact_when_one_id_holds_a_third_of_the_rows(spark, n):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("record_id"))
    # Rows of one id share one hash and can only be taken together.
    hot = 1000
    taken = P.exact_sample(frame, n).count()
    assert n <= taken < n + hot


def test_interval_is_widened_until_it_holds_the_rank(spark, monkeypatch):
    tried = []
    original = P._interval

    def narrow(hashed, record_id, n, rows, deviations):
        tried.append(deviations)
        return original(hashed, record_id, n, rows, deviations / 4000.0)

    monkeypatch.setattr(P, "_interval", narrow)
    frame = spark.range(2000).withColumnRenamed("id", "record_id")
    assert P.exact_sample(frame, 700).count() == 700
    assert len(tried) > 1


def test_sample_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        P.exact_sample(spark.range(3).withColumnRenamed("id", "record_id"), 0)


def test_repeated_ids_are_no_exact_sample(spark):
    frame = spark.range(10_000).selectExpr("id % 10 AS record_id")
    with pytest.raises(ValueError, match="repeat|occurs"):
        P.exact_sample(frame, 100)
    whole = P.exact_sample(spark.range(1000).selectExpr("id AS record_id"), 100)
    assert whole.count() == 100
