"""Point tables: validation, record ids, exact samples, histograms."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from centroidal.functions.keys import salted_key
from centroidal.operators.layout import small, written

_KEY_RANGE = (1 << 56) - 1
# Widest interval, in square roots of the sample size, for the hash of the last row drawn.
_MOST_DEVIATIONS = 5000.0
# A generated id is the partition in front of so many bits for the place in it.
_POSITION_BITS = 33
_POSITION_MASK = (1 << _POSITION_BITS) - 1
# Partitions whose counts are added up together first.
_BLOCKS_PER_GROUP = 1024
# Most partitions whose blocks are broadcast: some 100 bytes each, and 500 TB in splits of 128 MB.
SPLIT_ROWS = 4_000_000


def points_summary(points: DataFrame, label: str | None = None) -> DataFrame:
    """One row of everything the validity rules need, from one scan.

    ``rows, min_features, max_features, invalid_rows`` and, with a label column,
    ``labeled_rows, classes``.
    """
    features = F.col("features")
    # NaN sorts above +inf, so the extremes of a vector show any bad value.
    top, bottom = F.array_max(features), F.array_min(features)
    infinite = F.lit(float("inf"))
    invalid = (
        features.isNull()
        | (F.size(features) == 0)
        | F.isnan(top)
        | (top == infinite)
        | (bottom == -infinite)
        | F.exists(features, lambda value: value.isNull())
    )
    aggregates = [
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size(features)).alias("min_features"),
        F.max(F.size(features)).alias("max_features"),
        F.count_if(invalid).alias("invalid_rows"),
    ]
    if label is None:
        return points.agg(*aggregates)
    # Group by label first: a distinct count then only sees one row per label.
    per_label = points.groupBy(F.col(label).alias("label")).agg(*aggregates)
    return per_label.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.min("min_features").alias("min_features"),
        F.max("max_features").alias("max_features"),
        F.coalesce(F.sum("invalid_rows"), F.lit(0)).alias("invalid_rows"),
        F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("rows"))), F.lit(0)).alias("labeled_rows"),
        F.count("label").alias("classes"),
    )


def validate_points(
    points: DataFrame,
    *,
    name: str = "points",
    label: str | None = None,
    expected_rows: int | None = None,
    expected_features: int | None = None,
    expected_classes: int | None = None,
) -> dict[str, Any]:
    """Raise ValueError for a malformed point table, else return its summary."""
    found = points_summary(points, label).first().asDict()
    rows = found["rows"]
    if rows == 0:
        raise ValueError(f"{name}: no points")
    if found["invalid_rows"]:
        raise ValueError(f"{name}: {found['invalid_rows']} points are empty, null, NaN or infinite")
    if found["min_features"] != found["max_features"]:
        raise ValueError(
            f"{name}: points have between {found['min_features']} and {found['max_features']} features"
        )
    if expected_rows is not None and rows != expected_rows:
        raise ValueError(f"{name}: expected {expected_rows} rows, got {rows}")
    if expected_features is not None and found["min_features"] != expected_features:
        raise ValueError(f"{name}: expected {expected_features} features, got {found['min_features']}")
    summary = {"name": name, "rows": rows, "features": found["min_features"]}
    if label is not None:
        if found["labeled_rows"] != rows:
            raise ValueError(f"{name}: {rows} points but {found['labeled_rows']} labels")
        if expected_classes is not None and found["classes"] != expected_classes:
            raise ValueError(f"{name}: expected {expected_classes} classes, got {found['classes']}")
        summary["classes"] = found["classes"]
    return summary


def class_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, rows bigint)``."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def place_in_blocks(df: DataFrame, blocks: Sequence[Column], skip: Column | None = None) -> DataFrame:
    """Add ``_place, _inside, _number`` to consecutive blocks of rows.

    A block is a run of rows inside one partition, named by the ``blocks`` columns
    and ordered by them; ``skip`` of its first rows are not numbered.  ``_place`` is a row's
    0-based place in its block, ``_inside`` the rows that precede it under the same first block
    column (in its file, say), ``_number`` its number among the numbered rows of the table,
    null for skipped ones.

    Where the blocks begin depends on how the table is split when
    it is read, so the rows are written once with their block and place, and everything
    follows from that copy: the numbers cannot change or get lost when ``df`` would be split
    in another way later.  Spark adds up the block sizes in two levels, within a file or a
    group of partitions and then over these.  Every row finds its block by the partition in its
    place of the copy, from a broadcast table of one row per partition, so rows are
    numbered where they lie, without a shuffle.
    """
    names = [f"_block{i}" for i in range(len(blocks))]
    tagged = written(
        df.select(
            "*",
            *[b.alias(n) for b, n in zip(blocks, names)],
            (F.lit(0) if skip is None else skip).cast("int").alias("_skip"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "numbered",
    )
    sizes = tagged.groupBy(*names).agg(
        F.count(F.lit(1)).alias("rows"), F.min("_row").alias("first"), F.min("_skip").alias("skip")
    )
    outer = F.col(names[0]) if len(names) > 1 else F.floor(F.col(names[0]) / _BLOCKS_PER_GROUP)
    sizes = sizes.withColumn("outer", outer).withColumn("numbered", F.greatest(F.col("rows") - F.col("skip"), F.lit(0)))
    before = Window.partitionBy("outer").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("outer").rowsBetween(Window.unboundedPreceding, -1)  # one row per file or group
    starts = sizes.groupBy("outer").agg(F.sum("numbered").alias("n"))
    starts = starts.select("outer", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("start"))
    placed = sizes.withColumns(
        {"inside": F.coalesce(F.sum("rows").over(before), F.lit(0)), "below": F.coalesce(F.sum("numbered").over(before), F.lit(0))}
    ).join(starts, "outer")
    entry = F.struct("first", "inside", (F.col("start") + F.col("below") - F.col("skip")).alias("number"), "skip")
    lookup = placed.groupBy(F.shiftright("first", _POSITION_BITS).alias("_partition")).agg(
        F.sort_array(F.collect_list(entry)).alias("_blocks")  # as many as files or splits meet in a partition
    )
    lookup = written(lookup, "blocks")
    found = tagged.withColumn("_partition", F.shiftright("_row", _POSITION_BITS)).join(
        small(lookup, lookup.count(), SPLIT_ROWS), "_partition", "left"
    )
    several = F.element_at(F.filter("_blocks", lambda b: b["first"] <= F.col("_row")), -1)
    own = F.when(F.size("_blocks") == 1, F.get("_blocks", F.lit(0))).otherwise(several)
    lost = F.raise_error(F.lit("a row is in none of the counted blocks")).cast("bigint")
    found = found.withColumn("_own", own).withColumn("_place", F.coalesce(F.col("_row") - F.col("_own.first"), lost))
    number = F.when(F.col("_place") >= F.col("_own.skip"), F.col("_own.number") + F.col("_place"))
    return found.select(
        *[F.col(f"`{c}`") for c in df.columns],
        "_place",
        (F.col("_own.inside") + F.col("_place")).alias("_inside"),
        number.alias("_number"),
    )


def number_blocks(df: DataFrame, blocks: Sequence[Column], name: str = "record_id") -> DataFrame:
    """0-based contiguous row numbers over consecutive blocks of rows (see ``place_in_blocks``)."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    return place_in_blocks(df, blocks).select(F.col("_number").alias(name), *kept)


def assign_record_id(
    df: DataFrame, order_by: Sequence[str | Column] = (), *, name: str = "record_id"
) -> DataFrame:
    """Add ``record_id``: the 0-based position of each row.

    Without ``order_by`` the position follows the partitions of ``df`` as they are.
    With it the table is range-partitioned and sorted, so no task sees more than its
    range; the source position is the last sort key, which lets Spark split a range
    even when a third of the rows share one key.
    """
    if not order_by:
        return number_blocks(df, [F.spark_partition_id()], name)
    placed = df.withColumn("_source", F.monotonically_increasing_id())
    keys = [*order_by, "_source"]
    ranged = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_source")
    fixed = written(
        ranged.select(
            "*",
            F.spark_partition_id().alias("_range"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)).alias("_position"),
        ),
        "record-ids",
    )
    sizes = fixed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()
    offset, starts = 0, []
    for size in sorted(sizes, key=lambda row: row["_range"]):
        starts.append((size["_range"], offset))
        offset += size["n"]
    lookup = df.sparkSession.createDataFrame(starts, "_range int, _start bigint")
    numbered = fixed.join(small(lookup, len(starts)), "_range")
    return numbered.select((F.col("_start") + F.col("_position")).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def exact_sample(df: DataFrame, n: int, seed: int = 42, *, record_id: str = "record_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, in their original order.

    The sample is the n smallest ``(hash(seed, id), id)``, so it is a plain filter
    once the n-th smallest is known: no shuffle and no row limit, whatever n is.
    Hashes are uniform, which tells beforehand where the n-th lies to within a few
    square roots of n; one scan counts the rows below that interval and returns the
    hashes inside it.  Should the interval miss, it is widened.

    Record ids must be unique (``assign_record_id`` makes them so).  Rows that share an
    id can only be taken together, so if that would break the size it is an error.
    """
    if n <= 0:
        raise ValueError("the sample size must be positive")
    rows = df.count()
    if rows <= n:
        return df
    hashed = df.withColumn("_hash", salted_key(F.col(record_id), seed))
    deviations = 8.0
    while True:
        below, inside = _interval(hashed, record_id, n, rows, deviations)
        if below < n <= below + sum(row["n"] for row in inside):
            break
        deviations *= 8.0
        if deviations > _MOST_DEVIATIONS:
            raise ValueError("the record ids repeat too often to draw an exact sample")
    inside.sort(key=lambda row: (row["entry"]["_hash"], row["entry"]["id"]))
    reached = itertools.accumulate((row["n"] for row in inside), initial=below)
    position, total = next((i, total) for i, total in enumerate(reached) if total >= n)
    position -= 1
    if total != n:
        raise ValueError(f"record id {inside[position]['entry']['id']} occurs {inside[position]['n']} times at the cut")
    last = inside[position]["entry"]
    if position + 1 < len(inside) and inside[position + 1]["entry"]["_hash"] == last["_hash"]:
        cut = F.struct(F.lit(last["_hash"]).cast("bigint"), F.lit(last["id"]).cast(df.schema[record_id].dataType))
        return hashed.where(F.struct(F.col("_hash"), F.col(record_id)) <= cut).drop("_hash")
    return hashed.where(F.col("_hash") <= last["_hash"]).drop("_hash")


def _interval(hashed: DataFrame, record_id: str, n: int, rows: int, deviations: float) -> tuple[int, list[Row]]:
    """Rows below, and ``(entry (_hash, id), n)`` inside, the interval that should hold the n-th hash."""
    margin = deviations * (math.sqrt(n) + 1.0)
    low = int(max(0.0, (n - margin) / rows) * _KEY_RANGE)
    high = int(min(1.0, (n + margin) / rows) * _KEY_RANGE)
    entry = F.when(F.col("_hash") >= low, F.struct("_hash", F.col(record_id).alias("id")))
    found = (
        hashed.where(F.col("_hash") <= high)
        .groupBy(entry.alias("entry"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # about 2 * margin rows, and one for all rows below
    )
    below = sum(row["n"] for row in found if row["entry"] is None)
    return below, [row for row in found if row["entry"] is not None]
