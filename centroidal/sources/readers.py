"""Readers: point files, labelled CSV, KDD files, prepared tables, trial and quality tables."""

from __future__ import annotations

import csv
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from centroidal.functions.vectors import is_finite, pack
from centroidal.operators.layout import exact_partitions, small, written
from centroidal.operators.points import SPLIT_ROWS, number_blocks, place_in_blocks
from centroidal.operators.trials import QUALITY_SCHEMA, TRIAL_SCHEMA
from centroidal.sources import kdd

_BAD_RECORD, _ROW = "_bad_record", "_row_of_file"
# Orders in which the columns of one table may stand in its files.
MOST_HEADERS = 1000
_DATASET_ENDS = (".parquet", ".csv.gz")


def _numbered(scan: DataFrame) -> DataFrame:
    """Rows of a file scan with their 0-based position in the file(s)."""
    blocks = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    return number_blocks(scan, blocks)


def read_points_csv(
    spark: SparkSession,
    path: str,
    dimensions: int,
    *,
    expected_rows: int | None = None,
    n_partitions: int | None = None,
) -> DataFrame:
    """Header-less comma-separated floats as ``(record_id, features)``.

    A line that is not exactly ``dimensions`` numbers fails the job; so does a row
    count other than ``expected_rows``.  The record id is the position in the file.
    """
    if dimensions <= 0:
        raise ValueError("the number of features must be positive")
    if n_partitions is not None and n_partitions <= 0:
        raise ValueError("the number of partitions must be positive")
    schema = ", ".join(f"f{i} double" for i in range(dimensions))
    scan = spark.read.schema(schema).option("mode", "FAILFAST").csv(path)
    if expected_rows is not None:
        rows = scan.count()
        if rows != expected_rows:
            raise ValueError(f"{path}: expected {expected_rows} records, received {rows}")
    points = _numbered(scan).select("record_id", pack(*[f"f{i}" for i in range(dimensions)]).alias("features"))
    return points if n_partitions is None else exact_partitions(points, n_partitions)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _first_line(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()
    return next(csv.reader([first[0]])) if first and first[0] else []


def _headed(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The column names of headered CSV files and their rows ``(record_id, file, line, malformed, cells)``.

    Every file has a header of its own; the columns may stand in another order in each, and
    ``cells`` has them in the order of the first.  Other names, fewer or more, are an error
    that says which file.  ``record_id`` counts data rows over all files in path order,
    ``line`` counts the lines of a file that are not blank, from 1.
    """
    width = len(_first_line(spark, path))
    if not width:
        return [], spark.createDataFrame([], "record_id bigint, file string, line bigint, malformed boolean, cells array<string>")
    cells = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{c} string" for c in [*cells, _BAD_RECORD])
    scan = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD_RECORD).csv(path)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    named = scan.select("*", file.alias("_file"), (start == 0).alias("_begins"))
    rows = place_in_blocks(named, [file, start], skip=F.when(start == 0, 1).otherwise(0))

    # Different headers are few: the columns of one table in another order.
    header = F.when(F.col(_BAD_RECORD).isNull(), F.array(*cells))
    tops = rows.filter(F.col("_begins") & (F.col("_place") == 0)).select("_file", header.alias("names"))
    kinds = tops.groupBy("names").agg(F.min("_file").alias("file")).orderBy("file").take(MOST_HEADERS + 1)
    columns = kinds[0]["names"] or []
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"{path}: more than {MOST_HEADERS} different headers")
    for kind in kinds[1:]:
        if kind["names"] is None or sorted(map(str, kind["names"])) != sorted(map(str, columns)):
            raise ValueError(f"{kind['file']}: the header does not have the columns of {kinds[0]['file']}")
    if len(columns) != len(set(columns)):
        raise ValueError("the header repeats a column name")
    given = F.array(*cells)
    if len(kinds) > 1:
        # Only files in another order than the first are looked up, by a hash of their path.
        places = {tuple(kind["names"]): [kind["names"].index(c) for c in columns] for kind in kinds[1:]}
        orders = spark.createDataFrame([(list(n), p) for n, p in places.items()], "names array<string>, _order array<int>")
        others = tops.join(F.broadcast(orders), "names").select(F.xxhash64("_file").alias("_key"), "_order")
        others = written(others, "headers")
        rows = rows.withColumn("_key", F.xxhash64("_file")).join(small(others, others.count(), SPLIT_ROWS), "_key", "left")
        moved = F.transform("_order", lambda at: F.get(F.array(*cells), at))
        given = F.when(F.col("_order").isNull(), given).otherwise(moved)
    return columns, rows.filter("_number is not null").select(
        F.col("_number").alias("record_id"),
        F.col("_file").alias("file"),
        (F.col("_inside") + 1).alias("line"),
        F.col(_BAD_RECORD).isNotNull().alias("malformed"),
        given.alias("cells"),
    )


def _require_sound(checked: DataFrame, path: str) -> None:
    """Raise ValueError for the first row with a ``problem``, and for a table without rows."""
    found = checked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.when(F.col("problem").isNotNull(), F.struct("record_id", "problem", "file", "line"))).alias("first"),
    ).first()
    if found["first"]:
        raise ValueError(f"{found['first']['file']}: {found['first']['problem']} in row {found['first']['line']}")
    if not found["rows"]:
        raise ValueError(f"{path}: no data rows")


def read_labeled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV as ``(record_id, features, label bigint)``.

    Several files are one table; each has its own header, whose columns may stand in any
    order, and features are in the order of the first file.  The label never enters the
    features.  Missing or duplicate columns, other columns in another file, an input
    ``record_id``, ragged rows, text or non-finite features, labels that are not
    integers and empty files are errors; the first bad row (file line) is named.
    """
    columns, rows = _headed(spark, path)
    if "label" not in columns:
        raise ValueError("the file must have a header with a label column")
    if "record_id" in columns:
        raise ValueError("record_id is assigned by the reader and cannot be an input column")
    features = [c for c in columns if c != "label"]
    if not features:
        raise ValueError("the file must have at least one feature column")
    numbers = F.array(*[F.get("cells", F.lit(columns.index(c))).try_cast("double") for c in features])
    label = F.get("cells", F.lit(columns.index("label"))).try_cast("bigint")
    parsed = rows.select("record_id", "file", "line", "malformed", numbers.alias("features"), label.alias("label"))
    bad = F.array_position(F.transform("features", is_finite), F.lit(False))
    names = F.array(*[F.lit(c) for c in features])
    problem = (
        F.when(F.col("malformed"), F.lit("malformed row"))
        .when(bad > 0, F.concat(F.lit("invalid or non-finite feature in column "), F.get(names, (bad - 1).cast("int"))))
        .when(F.col("label").isNull(), F.lit("invalid label"))
    )
    checked = parsed.withColumn("problem", problem)
    _require_sound(checked, path)
    return checked.select("record_id", "features", "label")


def read_kdd_csv(spark: SparkSession, path: str, *, n_partitions: int | None = None) -> DataFrame:
    """Header-less 42-column connection records, plain or gzip.

    A gzip file is one split; give ``n_partitions`` to spread its rows afterwards.
    """
    table = spark.read.schema(kdd.SCHEMA).option("mode", "FAILFAST").csv(path)
    return table if n_partitions is None else table.repartition(n_partitions)


def is_absent(error: AnalysisException) -> bool:
    """Whether an error says that a path does not exist."""
    return error.getCondition() == "PATH_NOT_FOUND"


def list_datasets(spark: SparkSession, directory: str) -> list[str]:
    """Sorted names of the datasets that ``load_dataset`` finds in a folder; a missing folder has none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(directory)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted({name.removesuffix(end) for name in found for end in _DATASET_ENDS if name.endswith(end)})


def load_dataset(spark: SparkSession, name: str, directory: str) -> DataFrame:
    """``(features array<double>, label bigint)`` of a saved dataset; parquet first, then csv.gz."""
    try:
        table = spark.read.parquet(f"{directory}/{name}.parquet")
    except AnalysisException as absent:
        if not is_absent(absent):
            raise
        try:
            table = spark.read.option("header", True).csv(f"{directory}/{name}.csv.gz")
        except AnalysisException as error:
            if not is_absent(error):
                raise
            there = ", ".join(list_datasets(spark, directory)) or "none"
            raise FileNotFoundError(
                f"dataset {name} is not in {directory} (there: {there}); write it with save_dataset or prepare_kdd"
            ) from error
    features = sorted((c for c in table.columns if re.fullmatch(r"f\d+", c)), key=lambda c: int(c[1:]))
    return table.select(pack(*features).alias("features"), F.col("label").cast("bigint").alias("label"))


def _typed(table: DataFrame, schema: str) -> dict[str, Column]:
    """Parsed column per schema field; unparseable text gives null."""
    parsed = {}
    for entry in schema.split(", "):
        name, kind = entry.strip().split(" ")
        text = F.trim(F.col(name))
        if kind == "array<bigint>":
            parsed[name] = F.split(text, ";").try_cast(kind)
        elif kind == "boolean":
            parsed[name] = F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
        elif kind == "string":
            parsed[name] = F.col(name)
        else:
            parsed[name] = text.try_cast(kind)
    return parsed


def read_quality_table(spark: SparkSession, path: str) -> DataFrame:
    """Typed quality measurements from headered CSV.

    Missing columns, ragged rows, malformed or non-finite numbers, purity outside
    [0, 1], negative seconds, bad booleans, empty or negative cluster counts and
    empty files are errors; the first bad row is named.
    """
    columns, found = _headed(spark, path)
    missing = {entry.split(" ")[0] for entry in QUALITY_SCHEMA.split(", ")} - set(columns)
    if missing:
        raise ValueError(f"{path}: missing columns {sorted(missing)}")
    cells = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)]
    rows = found.select(F.struct("record_id", "file", "line", "malformed").alias(_ROW), *cells)
    typed = _typed(rows, QUALITY_SCHEMA)
    parsed = rows.select(_ROW, *[value.alias(name) for name, value in typed.items()])
    problems = [F.when(F.col(f"{_ROW}.malformed"), F.lit("malformed row"))]
    for name in typed:
        problems.append(F.when(F.col(name).isNull(), F.lit(f"invalid {name}")))
    for name in ("sse", "purity", "ari", "nmi", "elapsed_seconds"):
        problems.append(F.when(~is_finite(F.col(name)), F.lit(f"non-finite {name}")))
    problems += [
        F.when(~F.col("purity").between(0.0, 1.0 + 1e-9), F.lit("purity out of range")),
        F.when(F.col("elapsed_seconds") < 0, F.lit("negative elapsed_seconds")),
        F.when(F.exists("cluster_counts", lambda n: n.isNull() | (n < 0)), F.lit("invalid cluster_counts")),
    ]
    _require_sound(parsed.select(f"{_ROW}.*", F.coalesce(*problems).alias("problem")), path)
    return parsed.select(*typed)


def read_trials(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Trial records appended by ``append_trial``."""
    if format == "parquet":
        return spark.read.schema(TRIAL_SCHEMA).parquet(path)
    names = [entry.split(" ")[0] for entry in TRIAL_SCHEMA.split(", ")]
    text = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).csv(path)
    return text.select(*[value.alias(name) for name, value in _typed(text, TRIAL_SCHEMA).items()])
