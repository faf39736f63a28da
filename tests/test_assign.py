import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from centroidal.functions.keys import row_key, uniform, uniform_array
from centroidal.functions.vectors import nearest_center, pack, squared_euclidean, unpack
from centroidal.operators import assign as A

IDS, POINTS, LABELS = (100, 101, 102, 103), [(0, 0), (1, 0), (10, 10), (11, 10)], [5, 5, 9, 9]
CENTERS = [(0.0, 0.0), (10.0, 10.0)]


@pytest.fixture
def known(make_points):
    return make_points(POINTS, LABELS, IDS)


def test_predictions_keep_ids_and_labels(known):
    rows = A.predict(known, CENTERS).orderBy("record_id").collect()
    assert [r.record_id for r in rows] == list(IDS)
    assert [r.label for r in rows] == LABELS
    assert [r.cluster for r in rows] == [0, 0, 1, 1]
    assert sum(r.distance_sq for r in rows) == 2.0


def test_predictions_do_not_depend_on_partitioning(known):
    wanted = sorted(map(tuple, A.predict(known, CENTERS).select("record_id", "cluster").collect()))
    again = A.predict(known.repartition(3), CENTERS).select("record_id", "cluster").collect()
    assert sorted(map(tuple, again)) == wanted


def test_tie_goes_to_lowest_cluster_on_both_paths(make_points):
    middle = make_points([(1, 0)])
    compiled = A.assign(middle, [(0, 0), (2, 0)]).first()
    assert compiled.cluster == 0
    wide = make_points([[1.0] + [0.0] * 119])
    batched = A.assign(wide, [[0.0] * 120, [2.0] + [0.0] * 119]).first()
    assert batched.cluster == 0 and batched.distance_sq == 1.0


def test_compiled_and_arrow_paths_agree(spark, make_points):
    rng = np.random.default_rng(0)
    pts = make_points(rng.normal(size=(300, 5)).tolist())
    centers = rng.normal(size=(7, 5))
    compiled = pts.withColumn("b", nearest_center(F.col("features"), centers.tolist()))
    compiled = compiled.select("record_id", "b.cluster", "b.distance_sq")
    arrow = A.assign(pts, centers).select("record_id", "cluster", "distance_sq")
    joined = compiled.join(arrow.withColumnsRenamed({"cluster": "c2", "distance_sq": "d2"}), "record_id")
    assert joined.where("cluster = c2 and abs(distance_sq - d2) < 1e-9").count() == 300


def test_assign_applies_to_a_stream_unchanged(spark, known, tmp_path):
    known.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(known.schema).parquet(str(tmp_path / "in"))
    scored = A.assign(stream, CENTERS)
    query = (
        scored.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.processAllAvailable()
    query.stop()
    assert {r.cluster for r in spark.table("scored").collect()} == {0, 1}


def test_evaluation_counts_absent_clusters(known):
    rows = A.evaluate_centers(known, [*CENTERS, (99.0, 99.0)]).orderBy("cluster").collect()
    assert [(r.cluster, r.n, r.sse) for r in rows] == [(0, 2, 1.0), (1, 2, 1.0), (2, 0, 0.0)]
    assert [r.n for r in A.cluster_sizes(known, CENTERS).orderBy("cluster").collect()] == [2, 2]


def test_sse_of_given_assignment(spark, known):
    given = known.withColumn("cluster", F.when(F.col("record_id") < 102, 0).otherwise(1))
    assert A.sse(given, CENTERS).first().sse == 2.0
    for bad in (F.lit(2), F.lit(-1), F.lit(None).cast("int")):
        with pytest.raises(PySparkException):
            A.sse(known.withColumn("cluster", bad), CENTERS).collect()


def test_sse_of_a_large_model(spark, make_points):
    rng = np.random.default_rng(2)
    vectors, centers = rng.normal(size=(40, 60)), rng.normal(size=(3, 60))
    given = make_points(vectors.tolist()).withColumn("cluster", (F.col("record_id") % 3).cast("int"))
    wanted = ((vectors - centers[np.arange(40) % 3]) ** 2).sum()
    assert A.sse(given, centers).first().sse == pytest.approx(wanted)
    with pytest.raises(PySparkException, match="out of range"):
        A.sse(given.withColumn("cluster", F.lit(3)), centers).collect()


@pytest.mark.parametrize(
    "centers", [[], [(0.0,)], [(0.0, 0.0), (1.0,)], [(float("nan"), 0.0)], [(0.0, 0.0)] * 5]
)
def test_predict_rejects_bad_centers(known, centers):
    with pytest.raises(ValueError):
        A.predict(known, centers)


def test_predict_rejects_repeated_ids_and_bad_points(make_points):
    with pytest.raises(ValueError, match="occurs"):
        A.predict(make_points(POINTS, ids=(1, 1, 2, 3)), CENTERS)
    with pytest.raises(ValueError):
        A.predict(make_points([(0.0, float("inf")), (1, 1)]), CENTERS)
    with pytest.raises(ValueError):
        A.predict(make_points([]), CENTERS)


def test_centers_table_round_trip(spark):
    frame = A.centers_frame(spark, CENTERS)
    assert A.as_centers(frame).tolist() == [list(c) for c in CENTERS]
    with pytest.raises(ValueError, match="0..k-1"):
        A.as_centers(frame.withColumn("cluster", F.col("cluster") + 1))


def test_squared_euclidean_and_pack(spark):
    row = spark.createDataFrame([(1.0, 2.0, 4.0, 6.0)], "a double, b double, c double, d double")
    near, far = pack("a", "b"), pack("c", "d")
    assert row.select(squared_euclidean(near, far).alias("d2")).first().d2 == 25.0
    with pytest.raises(PySparkException, match="different lengths"):
        row.select(squared_euclidean(near, pack("a"))).collect()
    back = row.select(near.alias("features")).select(*unpack(F.col("features"), 2)).first()
    assert (back.f0, back.f1) == (1.0, 2.0)


def test_jvm_and_numpy_draws_are_identical(spark):
    key = row_key(F.col("id"))
    rows = spark.range(1000).select(key.alias("key"), uniform(key, 42, 3).alias("u")).collect()
    keys = np.array([r.key for r in rows])
    assert (uniform_array(keys, 42, 3) == np.array([r.u for r in rows])).all()


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
@pytest.mark.parametrize("width", [2, 40])
def test_unusable_features_are_an_error_in_small_and_large_models(spark, bad, width):
    points = spark.createDataFrame([(1, [0.0] * width), (2, [bad] + [1.0] * (width - 1))], "record_id bigint, features array<double>")
    centers = [[0.0] * width, [1.0] * width]
    for run in (A.assign, A.evaluate_centers, lambda p, c: A.sse(p.selectExpr("*", "0 AS cluster"), c)):
        with pytest.raises(PySparkException, match="finite|null|NaN"):
            run(points, centers).collect()
