import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from centroidal.deploy import ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("centroidal-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


@pytest.fixture(scope="session")
def make_points(spark):
    def build(vectors, labels=None, ids=None, partitions=None):
        ids = list(ids) if ids is not None else list(range(len(vectors)))
        rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
        schema = "record_id bigint, features array<double>"
        if labels is not None:
            kind = "string" if labels and isinstance(labels[0], str) else "bigint"
            rows = [(*row, label) for row, label in zip(rows, labels)]
            schema += f", label {kind}"
        df = spark.createDataFrame(rows, schema)
        return df if partitions is None else df.repartition(partitions)

    return build
