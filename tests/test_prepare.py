import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from centroidal.operators import moments as M
from centroidal.operators import prepare as R
from centroidal.plans.preparation import prepare_kdd, preprocess_kdd
from centroidal.sources import kdd
from centroidal.sources.readers import load_dataset, read_kdd_csv


def fake_connections(spark, per_label):
    rng = random.Random(1)
    rows = []
    for label, n in per_label.items():
        for _ in range(n):
            row = [rng.random() for _ in kdd.COLUMNS]
            for name, values in (("protocol_type", "tcp udp icmp"), ("service", "http smtp ftp"), ("flag", "SF S0")):
                row[kdd.COLUMNS.index(name)] = rng.choice(values.split())
            row[kdd.COLUMNS.index("num_outbound_cmds")] = 0.0
            rows.append((*row, label + "."))
    return spark.createDataFrame(rows, kdd.SCHEMA)


LABELS = {"normal": 10, "smurf": 10, "satan": 5, "guess_passwd": 5, "buffer_overflow": 3, "rootkit": 2}


def test_labels_are_normalized(spark):
    frame = spark.createDataFrame([(" smurf.. ",), ("normal.",), ("\tback",), ("a.b.",), (None,)], "label string")
    rows = frame.select(R.normalize_label(F.col("label"))).collect()
    assert [r[0] for r in rows] == ["smurf", "normal", "back", "a.b", "nan"]


def test_unknown_labels_are_listed(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("known",), ("b",)], "label string")
    mapped = R.map_category(frame, "label", {"known": "k"})
    assert [r[0] for r in R.unmapped_labels(mapped, "label").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        R.require_mapped(mapped, "label")


def test_codes_rank_the_remaining_values(spark):
    frame = spark.createDataFrame([("b", 1), ("a", 2), ("z", 3), (None, 4), ("b", 5)], "v string, id int")
    rows = R.ordinal_encode(frame, ["v"]).orderBy("id").collect()
    assert [r.v for r in rows] == [1, 0, 3, 2, 1]  # null is coded as the text nan
    rows = R.ordinal_encode(frame.where("id <> 2"), ["v"]).orderBy("id").collect()
    assert [r.v for r in rows] == [0, 2, 1, 0]


def test_large_dictionaries_are_ranked_by_spark(spark, monkeypatch):
    monkeypatch.setattr(R, "DICTIONARY_ROWS", 5)
    frame = spark.range(40).select("id", F.format_string("v%03d", F.col("id")).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    rows = R.ordinal_encode(frame, ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in rows] == [(i, i % 3) for i in range(40)]


def test_encode_label_uses_fixed_positions(spark):
    frame = spark.createDataFrame([("dos",), ("r2l",), ("other",)], "c string")
    assert [r[0] for r in frame.select(R.encode_label(F.col("c"), kdd.LABELS)).collect()] == [0, 3, None]


def test_z_scores(spark):
    values = np.random.default_rng(0).normal(5, 3, size=(1000, 2))
    frame = spark.createDataFrame([(float(a), float(b), 0.1) for a, b in values], "a double, b double, c double")
    rows = np.array(R.standardize(frame, ["a", "b", "c"]).collect())
    assert np.allclose(rows[:, :2], (values - values.mean(0)) / values.std(0))
    assert (rows[:, 2] == 0).all()  # exactly, although the mean of 0.1 is not 0.1


def test_float32_input_is_scaled_in_double(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "a float")
    assert R.standardize(frame, ["a"]).schema["a"].dataType.simpleString() == "double"


def test_nested_prefixes_use_their_own_statistics(spark):
    frame = spark.range(100).select(F.col("id").alias("record_id"), F.col("id").cast("double").alias("x"), F.lit(3).alias("label"))
    nested = R.nested_prefixes(frame, [10, 100], ["x"])
    found = nested.groupBy("size").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("size")
    assert [(r["size"], r.n) for r in found.collect()] == [(10, 10), (100, 100)]
    assert all(abs(r.m) < 1e-9 and r.s == pytest.approx(1) for r in found.collect())
    with pytest.raises(ValueError):
        R.nested_prefixes(frame, [0], ["x"])


def test_connections_are_prepared(spark):
    prepared = preprocess_kdd(fake_connections(spark, LABELS))
    rows = prepared.points.collect()
    assert len(rows) == 30 and {len(r.features) for r in rows} == {41}
    assert sorted(r.label for r in rows) == [0] * 10 + [1] * 10 + [2] * 5 + [3] * 5
    constant = kdd.COLUMNS.index("num_outbound_cmds")
    assert all(r.features[constant] == 0 for r in rows)
    summary = {r.metric: r.value for r in prepared.summary.collect()}
    assert summary == {
        "rows_raw": 35, "rows_dropped": 5, "rows_final": 30, "features": 41, "classes": 4,
        "difference_to_expected": 30 - 493_970, "rows_dos": 10, "rows_normal": 10, "rows_probe": 5, "rows_r2l": 5,
    }


def test_unknown_attack_is_rejected(spark):
    with pytest.raises(ValueError, match="totally_new_attack"):
        preprocess_kdd(fake_connections(spark, {"normal": 3, "totally_new_attack": 2}))


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_connection_files_to_saved_dataset(spark, tmp_path, compression):
    raw = str(tmp_path / "raw")
    fake_connections(spark, LABELS).write.option("compression", compression).csv(raw)
    path, summary = prepare_kdd(read_kdd_csv(spark, raw, n_partitions=3), str(tmp_path))
    assert path.endswith("kdd99.parquet")
    assert {r.metric: r.value for r in summary.collect()}["rows_final"] == 30
    loaded = load_dataset(spark, "kdd99", str(tmp_path))
    assert loaded.count() == 30 and {len(r.features) for r in loaded.collect()} == {41}


def test_saving_requires_all_classes(spark, tmp_path):
    with pytest.raises(ValueError, match="classes"):
        prepare_kdd(fake_connections(spark, {"normal": 3, "smurf": 3}), str(tmp_path))


def test_fixed_categories():
    assert len(kdd.COLUMNS) == 41 and len(kdd.ATTACK_CATEGORY) == 23
    assert sorted(k for k, v in kdd.ATTACK_CATEGORY.items() if v == "u2r") == ["buffer_overflow", "loadmodule", "perl", "rootkit"]


def test_rows_without_a_class_are_not_dropped(spark):
    frame = spark.createDataFrame([("a",), (None,), ("u",)], "category string")
    kept = R.drop_class(frame, "category", "u")
    assert {r.category for r in kept.collect()} == {"a", None}
    assert kept.count() == R.drop_report(frame, "category", "u").first().rows_final


def test_the_error_counts_all_unknown_labels(spark):
    frame = spark.range(1500).selectExpr("concat('l', id) AS label", "CAST(null AS string) AS category")
    with pytest.raises(ValueError, match="1500 unknown labels"):
        R.require_mapped(frame, "label")


def test_moments_are_those_of_numpy_whatever_the_layout(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 3)
    values = np.random.default_rng(3).normal(1e6, 2.0, size=(4000, 3))
    rows = [(i, float(a), None if i % 7 == 0 else float(b), float(c), None) for i, (a, b, c) in enumerate(values)]
    frame = spark.createDataFrame(rows, "record_id bigint, a double, b double, `c.d` double, none double")
    columns = ["a", "b", "c.d", "none"]
    wanted = [values[:, 0], values[np.arange(4000) % 7 != 0, 1], values[:, 2]]
    for parts in (1, 10):
        found = M.gathered(M.band_moments(frame.repartition(parts), columns))[0].columns()
        for (mean, std, low, high), column in zip(found, wanted):
            assert (low, high) == (column.min(), column.max())
            assert mean == pytest.approx(column.mean(), rel=1e-14) and std == pytest.approx(column.std(), rel=1e-9)
        assert found[3] == (None,) * 4
    assert M.gathered(M.band_moments(frame.limit(0), columns)) == {}


def test_prefixes_are_sums_of_bands(spark):
    values = np.random.default_rng(4).normal(size=300)
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "record_id bigint, x double").repartition(5)
    found = R.prefix_moments(frame, [300, 10, 50, 50, 900], ["x"])
    assert list(found) == [10, 50, 300, 900]
    for size, moments in found.items():
        mean, std, low, high = moments.columns()[0]
        own = values[:size]
        assert moments.n[0] == len(own) and (low, high) == (own.min(), own.max())
        assert mean == pytest.approx(own.mean()) and std == pytest.approx(own.std())
    late = R.prefix_moments(frame.where("record_id >= 50"), [10, 100], ["x"])
    assert list(late) == [100] and late[100].n[0] == 50


def test_statistics_are_vectors_per_task_and_nothing_is_exploded(spark):
    frame = spark.range(0, 1000, 1, 8).select("id", *[(F.col("id") % (i + 2)).alias(f"f{i}") for i in range(20)])
    names = [f"f{i}" for i in range(20)]
    moments = M.band_moments(frame, names)
    assert "Generate" not in moments._jdf.queryExecution().executedPlan().toString()
    assert M.partial_moments(frame, names).count() == 8  # one row per task, whatever the width
    band = F.when(F.col("id") < 500, 0).otherwise(1)
    assert M.partial_moments(frame, names, band).count() == 8 and M.band_moments(frame, names, band).count() == 2
