import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from centroidal.operators.trials import TRIAL_SCHEMA
from centroidal.sources import readers as S
from centroidal.sources import writers as W


def write(tmp_path, text, name="data.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_points_file(spark, tmp_path):
    path = write(tmp_path, "1.5,2\n-3,4e-3\n5,6\n")
    points = S.read_points_csv(spark, path, 2, expected_rows=3, n_partitions=2)
    assert points.rdd.getNumPartitions() == 2
    rows = points.orderBy("record_id").collect()
    assert [(r.record_id, r.features) for r in rows] == [(0, [1.5, 2.0]), (1, [-3.0, 0.004]), (2, [5.0, 6.0])]


def test_points_file_over_many_splits_keeps_file_order(spark, tmp_path):
    path = write(tmp_path, "".join(f"{i},{i * 2}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        points = S.read_points_csv(spark, path, 2)
        assert points.rdd.getNumPartitions() > 5
        rows = points.orderBy("record_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.record_id, r.features[0]) for r in rows] == [(i, float(i)) for i in range(5000)]


def test_points_file_rules(spark, tmp_path):
    path = write(tmp_path, "1,2\n3,4\n")
    with pytest.raises(ValueError, match="expected 3 records, received 2"):
        S.read_points_csv(spark, path, 2, expected_rows=3)
    for bad in ({"dimensions": 0}, {"dimensions": 2, "n_partitions": 0}):
        with pytest.raises(ValueError):
            S.read_points_csv(spark, path, **bad)
    for text in ("1,2\n3\n", "1,x\n", "1,2,3\n"):
        with pytest.raises((PySparkException, Py4JJavaError), match="(?i)malformed"):
            S.read_points_csv(spark, write(tmp_path, text, "bad.csv"), 2).collect()


def test_labeled_file(spark, tmp_path):
    path = write(tmp_path, "f0,label,f1\n1.0,7,2.0\n3,8,4\n-1e2,7,0.5\n")
    rows = S.read_labeled_csv(spark, path).orderBy("record_id").collect()
    assert [(r.record_id, r.features, r.label) for r in rows] == [(0, [1, 2], 7), (1, [3, 4], 8), (2, [-100, 0.5], 7)]


@pytest.mark.parametrize(
    "text, message",
    [
        ("a,b\n1,2\n", "label"),
        ("a,a,label\n1,2,3\n", "repeats"),
        ("record_id,a,label\n1,2,3\n", "record_id"),
        ("label\n1\n", "feature"),
        ("a,label\n", "no data"),
        ("", "header"),
        ("a,b,label\n1,2,3\n1,2\n", "malformed row in row 3"),
        ("a,label\n1,2,3\n", "malformed row in row 2"),
        ("a,label\n1,0\nx,1\n", "column a in row 3"),
        ("a,label\nnan,0\n", "non-finite feature in column a in row 2"),
        ("a,label\ninf,0\n", "non-finite"),
        ("a,label\n1,zero\n", "invalid label in row 2"),
        ("a,label\n1,1.5\n", "invalid label"),
        ("a,label\n,1\n", "column a"),
    ],
)
def test_labeled_file_rules(spark, tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        S.read_labeled_csv(spark, write(tmp_path, text)).collect()


def write_files(folder, **texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_files_whose_columns_stand_in_another_order(spark, tmp_path):
    path = write_files(
        tmp_path / "several",
        a="x,y,label\n1,2,0\n",
        b="y,x,label\n20,10,1\n40,30,2\n",
        c="label,y,x\n3,60,50\n",
        d="x,y,label\n70,80,4\n",
    )
    rows = S.read_labeled_csv(spark, path).orderBy("record_id").collect()
    assert [(r.record_id, r.features, r.label) for r in rows] == [
        (0, [1, 2], 0), (1, [10, 20], 1), (2, [30, 40], 2), (3, [50, 60], 3), (4, [70, 80], 4),
    ]


@pytest.mark.parametrize(
    "second, message",
    [
        ("x,z,label\n1,2,0\n", "b.csv: the header does not have the columns of .*a.csv"),
        ("x,label\n1,0\n", "b.csv: the header"),
        ("x,y,label,w\n1,2,0,4\n", "b.csv: the header"),
        ("y,x,label\n1,2,0\n1,nope,0\n", "b.csv: invalid or non-finite feature in column x in row 3"),
        ("y,x,label\n1,2\n", "b.csv: malformed row in row 2"),
    ],
)
def test_files_that_do_not_belong_together(spark, tmp_path, second, message):
    path = write_files(tmp_path / "several", a="x,y,label\n1,2,0\n", b=second)
    with pytest.raises(ValueError, match=message):
        S.read_labeled_csv(spark, path).collect()


def test_ids_over_files_in_many_splits(spark, tmp_path):
    """No exchange of rows, and ids in file order, however the files are split."""
    texts = {f"f{k}": ("x,label\n" if k % 2 else "label,x\n") + "".join(f"{i},{i}\n" for i in range(900 * k, 900 * k + 900)) for k in range(5)}
    path = write_files(tmp_path / "several", **texts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = S.read_labeled_csv(spark, path)
        assert found.rdd.getNumPartitions() > 5
        rows = found.orderBy("record_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.record_id, r.features[0], r.label) for r in rows] == [(i, float(i), i) for i in range(4500)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_quality_files_in_another_order(spark, tmp_path):
    names = [entry.split(" ")[0] for entry in S.QUALITY_SCHEMA.split(", ")]
    row = dict(zip(names, ["d", "parallel_kmeans", "local[1]", "10", "2", "3", "1.5", "0.5", "0.25", "0.125", "5;5", "2.0", "4", "True"]))
    texts = {n: ",".join(order) + "\n" + ",".join(row[c] for c in order) + "\n" for n, order in (("a", names), ("b", names[::-1]))}
    first, second = S.read_quality_table(spark, write_files(tmp_path / "several", **texts)).collect()
    assert first == second and (first.purity, first.cluster_counts, first.converged) == (0.5, [5, 5], True)


def test_dataset_that_cannot_be_read_is_not_missing(spark, tmp_path):
    (tmp_path / "d.parquet").mkdir()
    (tmp_path / "d.parquet" / "part.parquet").write_text("this is no parquet file at all")
    with pytest.raises(Exception) as caught:
        S.load_dataset(spark, "d", str(tmp_path)).collect()
    assert not isinstance(caught.value, FileNotFoundError)


def test_dataset_round_trip(spark, make_points, tmp_path):
    points = make_points([[i / 3 + j for j in range(12)] for i in range(50)], [i % 4 for i in range(50)])
    W.save_dataset(points, "d", str(tmp_path), 12)
    wide = spark.read.parquet(str(tmp_path / "d.parquet"))
    assert wide.columns == [f"f{i}" for i in range(12)] + ["label"]
    wanted = sorted((r.features, r.label) for r in points.collect())
    assert sorted((r.features, r.label) for r in S.load_dataset(spark, "d", str(tmp_path)).collect()) == wanted


def test_dataset_from_gzip_csv_and_missing(spark, tmp_path):
    frame = spark.createDataFrame([(1.5, 2.5, 3)], "f0 double, f1 double, label bigint")
    frame.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "g.csv.gz"))
    assert S.load_dataset(spark, "g", str(tmp_path)).first().features == [1.5, 2.5]
    with pytest.raises(FileNotFoundError, match="save_dataset"):
        S.load_dataset(spark, "none", str(tmp_path))


def test_split_keeps_ids_and_never_overwrites(spark, make_points, tmp_path):
    points = make_points([(i, -i) for i in range(20)], [i % 3 for i in range(20)])
    features, labels = W.split_features_labels(points, str(tmp_path), "s", 3)
    assert spark.read.parquet(features).columns == ["record_id", "features"]
    joined = spark.read.parquet(features).join(spark.read.parquet(labels), "record_id")
    assert joined.where((F.col("label") == F.col("record_id") % 3) & (F.col("features")[0] == F.col("record_id"))).count() == 20
    with pytest.raises(PySparkException, match="(?i)exists"):
        W.split_features_labels(points, str(tmp_path), "s", 3)
    for k in (0, 21):
        with pytest.raises(ValueError):
            W.split_features_labels(points, str(tmp_path), "other", k)


def trial(spark, **values):
    defaults = {
        "experiment_id": "e1", "dataset_name": "d", "num_records": 10, "num_features": 2, "num_clusters": 3,
        "num_partitions": 4, "spark_master": "local[1]", "random_seed": 42, "local_max_iterations": 100,
        "global_max_iterations": 100, "local_tolerance": 1e-6, "global_cost_tolerance": 1e-6,
        "aggregation_restarts": 5, "materialized_record_count": 10, "converged": True, "iterations": 3, "sse": 1.25,
        "cluster_counts": [5, 0, 5], "partition_clustering_seconds": 0.5, "center_aggregation_seconds": 0.25,
        "initialization_seconds": 0.75, "global_clustering_seconds": 1.0, "final_evaluation_seconds": 0.125,
        "total_runtime_seconds": 2.0,
    }
    row = {**defaults, **values}
    return spark.createDataFrame([tuple(row[e.split(" ")[0]] for e in TRIAL_SCHEMA.split(", "))], TRIAL_SCHEMA)


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_trials_append(spark, tmp_path, format):
    path = str(tmp_path / "deep" / "trials")
    W.append_trial(trial(spark), path, format)
    W.append_trial(trial(spark, experiment_id="e2", converged=False), path, format)
    rows = S.read_trials(spark, path, format).orderBy("experiment_id").collect()
    assert [(r.experiment_id, r.converged, r.cluster_counts, r.sse) for r in rows] == [
        ("e1", True, [5, 0, 5], 1.25),
        ("e2", False, [5, 0, 5], 1.25),
    ]
    if format == "csv":
        texts = [p.read_text() for p in (tmp_path / "deep" / "trials").glob("*.csv")]
        assert all(t.count("experiment_id") == 1 for t in texts)
        assert sum(t.count("5;0;5") for t in texts) == 2


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_trials_appended_again_add_nothing(spark, tmp_path, format):
    path = str(tmp_path / "once" / "trials")
    first, second = trial(spark), trial(spark, experiment_id="e2", sse=7.5)
    assert W.append_trials_once(first, path, format) == 1
    assert W.append_trials_once(first, path, format) == 0
    # A job that was lost after some of its rows, run again with all of them.
    assert W.append_trials_once(first.union(second), path, format) == 1
    assert W.append_trials_once(first.limit(0), path, format) == 0
    rows = S.read_trials(spark, path, format).orderBy("experiment_id").collect()
    assert rows == first.union(second).orderBy("experiment_id").collect()
    for bad in (first.union(first), trial(spark, experiment_id=None)):
        with pytest.raises(ValueError, match="unique and not null"):
            W.append_trials_once(bad, path, format)
    assert S.read_trials(spark, path, format).count() == 2


def test_datasets_are_listed(spark, make_points, tmp_path):
    assert S.list_datasets(spark, str(tmp_path / "missing")) == []
    W.save_dataset(make_points([(1.0, 2.0)], [0]), "b", str(tmp_path), 2)
    frame = spark.createDataFrame([(1.5, 3)], "f0 double, label bigint").write.option("header", True)
    frame.csv(str(tmp_path / "a.csv.gz"))
    (tmp_path / "notes.txt").write_text("x")
    assert S.list_datasets(spark, str(tmp_path)) == ["a", "b"]
    with pytest.raises(FileNotFoundError, match="there: a, b"):
        S.load_dataset(spark, "c", str(tmp_path))


HEADER = "dataset,algorithm,master,records,features,clusters,sse,purity,ari,nmi,cluster_counts,elapsed_seconds,iterations,converged\n"
ROW = "s,parallel_kmeans,local[1],1000,20,5,1032.37,1.0,1.0,1.0,218;191;206;192;193,1.6055,3,True\n"


def test_quality_file(spark, tmp_path):
    row = S.read_quality_table(spark, write(tmp_path, HEADER + ROW)).first()
    assert (row.dataset, row.records, row.sse, row.converged) == ("s", 1000, 1032.37, True)
    assert row.cluster_counts == [218, 191, 206, 192, 193]


@pytest.mark.parametrize(
    "old, new, message",
    [
        ("1032.37", "notanumber", "invalid sse in row 2"),
        ("1032.37", "nan", "non-finite sse"),
        ("1032.37,1.0", "1032.37,1.5", "purity out of range"),
        ("1.6055", "-1", "negative elapsed"),
        ("True", "maybe", "invalid converged"),
        ("218;191;206;192;193", "", "cluster_counts"),
        ("218;191;206;192;193", "1;x", "cluster_counts"),
        ("218;191;206;192;193", "1;-2", "cluster_counts"),
        (",True", "", "malformed row"),
        (ROW, "", "no data rows"),
    ],
)
def test_quality_file_rules(spark, tmp_path, old, new, message):
    with pytest.raises(ValueError, match=message):
        S.read_quality_table(spark, write(tmp_path, HEADER + ROW.replace(old, new)))


def test_quality_file_needs_all_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns"):
        S.read_quality_table(spark, write(tmp_path, "dataset,algorithm\ns,parallel_kmeans\n"))
    assert S.read_quality_table(spark, write(tmp_path, HEADER + ROW.replace("True", " TRUE "), "b.csv")).first().converged


def test_predictions(spark, make_points, tmp_path):
    assigned = make_points([(0,), (1,)], [5, 6]).withColumn("cluster", F.lit(1))
    table = W.predictions_table({(1, 42): assigned, (2, 43): assigned}, "d")
    path = W.write_predictions(table, str(tmp_path / "p"), records=2, repetitions=2)
    rows = spark.read.parquet(path).orderBy("repetition", "record_id").collect()
    assert tuple(rows[3]) == ("d", 2, 43, 1, 6, 1) and spark.read.parquet(path).columns == list(W.PREDICTION_COLUMNS)
    with pytest.raises(ValueError, match="expected 6"):
        W.write_predictions(table, str(tmp_path / "q"), records=3, repetitions=2)
    with pytest.raises(PySparkException, match="(?i)exists"):
        W.write_predictions(table, path, records=2, repetitions=2)
    with pytest.raises(ValueError):
        W.predictions_table({}, "d")


def test_sample_file(spark, make_points, tmp_path):
    points = make_points([(i / 7, i) for i in range(300)], [1] * 300)
    path = W.write_sample(points, str(tmp_path / "s"), 2, 100)
    rows = spark.read.option("header", True).csv(path).collect()
    assert len(rows) == 100
    assert all(len(r.f0.split(".")[1]) == 5 for r in rows)


def test_ids_do_not_depend_on_later_splits(spark, tmp_path):
    path = tmp_path / "points.csv"
    path.write_text("".join(f"{i},{i % 7}\n" for i in range(20_000)))
    points = S.read_points_csv(spark, str(path), 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = points.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.record_id for r in rows) == list(range(20_000))
    assert all(r.features[0] == r.record_id for r in rows)
