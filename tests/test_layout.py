from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from centroidal.operators import layout as Y


def test_empty_partitions_are_counted(spark):
    frame = spark.range(10, numPartitions=4).where("id < 3")
    rows = Y.count_partition_records(frame).orderBy("partition").collect()
    assert [(r.partition, r.records) for r in rows] == [(0, 2), (1, 1), (2, 0), (3, 0)]


@pytest.mark.parametrize("n", [2, 5, 9])
def test_exact_partitions(spark, n):
    frame = spark.range(100, numPartitions=5)
    placed = Y.exact_partitions(frame, n)
    assert placed.rdd.getNumPartitions() == n and placed.count() == 100
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (n > 5)
    with pytest.raises(ValueError):
        Y.exact_partitions(frame, 0)


def test_materialized_releases_also_on_failure(spark):
    frame = spark.range(10)
    with Y.materialized(frame, 10) as (cached, rows):
        assert rows == 10 and cached.storageLevel.useMemory
    assert not frame.storageLevel.useMemory
    with pytest.raises(RuntimeError), Y.materialized(frame):
        raise RuntimeError
    assert not frame.storageLevel.useMemory
    with pytest.raises(ValueError, match="expected 11"), Y.materialized(frame, 11):
        pass
    assert not frame.storageLevel.useMemory


def test_buckets_are_even_and_stable(spark):
    frame = spark.range(20_000).withColumnRenamed("id", "record_id")
    rows = Y.with_bucket(frame, 8).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    assert {r.bucket for r in rows} == set(range(8)) and min(r.n for r in rows) > 2200
    moved = Y.with_bucket(frame.repartition(7), 8)
    assert moved.join(Y.with_bucket(frame, 8), ["record_id", "bucket"]).count() == 20_000
    with pytest.raises(ValueError):
        Y.with_bucket(frame, 0)


def test_written_tables_go_to_the_shared_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert Y.scratch_path(spark, "x").startswith(folder)
    back = Y.written(spark.range(5), "numbers")
    assert back.count() == 5 and folder in back.inputFiles()[0]


@pytest.mark.parametrize("master, allowed", [("local[4]", True), ("spark://host:7077", False)])
def test_without_a_shared_folder_only_a_local_session_may_write(master, allowed):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master=master)
    )
    if allowed:
        assert "centroidal-" in Y.scratch_path(session, "x")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            Y.scratch_path(session, "x")
