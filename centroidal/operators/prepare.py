"""Preparation of raw tables: labels, categories, scaling, nested sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centroidal.operators.layout import small
from centroidal.operators.moments import Moments, band_moments, gathered
from centroidal.operators.points import assign_record_id

# A category dictionary up to this many entries travels as a small local table and
# is broadcast; a larger one is ranked and joined as a distributed table.
DICTIONARY_ROWS = 100_000
# Unknown labels that an error names.
NAMED_LABELS = 20
_MISSING = "nan"  # text of a missing category


def normalize_label(label: Column) -> Column:
    """Text of a label without surrounding blanks and trailing dots."""
    text = F.coalesce(label.cast("string"), F.lit(_MISSING))
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\.+$", "")


def map_category(df: DataFrame, label: str, mapping: Mapping[str, str], out: str = "category") -> DataFrame:
    """Left join with a fixed mapping; unmapped labels give null (see ``require_mapped``)."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), f"`{label}` string, `{out}` string")
    columns = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.join(small(table, len(mapping)), label, "left").select(*columns, out)


def unmapped_labels(df: DataFrame, label: str, category: str = "category") -> DataFrame:
    """Sorted distinct labels that have no category."""
    return df.where(F.col(category).isNull()).select(label).distinct().orderBy(label)


def require_mapped(df: DataFrame, label: str, category: str = "category") -> DataFrame:
    """Raise ValueError if there are unmapped labels, else return ``df``.

    The error says how many there are and names the first of them; all are rows of
    ``unmapped_labels``.
    """
    unmapped = unmapped_labels(df, label, category)
    named = [row[0] for row in unmapped.take(NAMED_LABELS)]
    if named:
        total = unmapped.count()
        raise ValueError(f"{total} unknown labels (unmapped_labels has them all), the first are: {named}")
    return df


def drop_class(df: DataFrame, category: str, dropped: str) -> DataFrame:
    """Rows of every other class, and rows without one."""
    return df.where(~F.col(category).eqNullSafe(dropped))


def drop_report(df: DataFrame, category: str, dropped: str) -> DataFrame:
    """One row ``rows_raw, rows_dropped, rows_final``."""
    gone = F.coalesce(F.col(category) == dropped, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("rows_raw"),
        F.count_if(gone).alias("rows_dropped"),
        F.count_if(~gone).alias("rows_final"),
    )


def category_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, rows)`` of several text columns from one scan."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(_MISSING)).alias("value"))
        for c in columns
    ]
    return (
        df.select(F.explode(F.array(*pairs)).alias("entry"))
        .groupBy("entry.column", "entry.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def category_codes(values: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, int | None]:
    """``(column, value, code int)`` and its row count, None when too many to count cheaply.

    The code is the rank of a value among the sorted values of its column.
    """
    spark = values.sparkSession
    few = values.select("column", "value").limit(DICTIONARY_ROWS + 1).collect()
    if len(few) <= DICTIONARY_ROWS:
        rows = []
        for column in columns:
            # Byte order, which is also Spark's string order.
            ordered = sorted((r["value"] for r in few if r["column"] == column), key=lambda v: v.encode())
            rows += [(column, value, code) for code, value in enumerate(ordered)]
        return spark.createDataFrame(rows, "column string, value string, code int"), len(rows)
    ranked = assign_record_id(values.select("column", "value"), ["column", "value"], name="position")
    first = ranked.groupBy("column").agg(F.min("position").alias("first"))
    codes = ranked.join(small(first, len(columns)), "column").select(
        "column", "value", (F.col("position") - F.col("first")).cast("int").alias("code")
    )
    return codes, None


def ordinal_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace text columns by the rank of their value among the sorted distinct values."""
    codes, entries = category_codes(category_values(df, columns), columns)
    encoded = df
    for column in columns:
        key, code = f"_key_{column}", f"_code_{column}"
        lookup = codes.where(F.col("column") == column).select(F.col("value").alias(key), F.col("code").alias(code))
        lookup = lookup if entries is None else small(lookup, entries)
        text = F.coalesce(F.col(column).cast("string"), F.lit(_MISSING))
        encoded = encoded.withColumn(key, text).join(lookup, key, "left").withColumn(column, F.col(code))
    return encoded.select(*[F.col(f"`{c}`") for c in df.columns])


def encode_label(category: Column, names: Sequence[str]) -> Column:
    """Fixed integer id: the position of the category in ``names``; other values are null."""
    position = F.array_position(F.array(*[F.lit(n) for n in names]), category)
    return F.when(position > 0, (position - 1).cast("bigint"))


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-score with the population deviation; constant columns become 0.

    A constant column is recognised by its range: the mean of equal doubles need not
    equal them in the last bit.
    """
    if not columns:
        return df
    found = gathered(band_moments(df, columns))
    if not found:
        return df
    moments = dict(zip(columns, found[0].columns()))

    def scaled(c: str) -> Column:
        mean, deviation, low, high = moments[c]
        value = F.col(f"`{c}`").cast("double")
        if low == high or not deviation:
            return F.when(value.isNotNull(), F.lit(0.0))
        return (value - F.lit(mean)) / F.lit(deviation)

    return df.select(*[scaled(c).alias(c) if c in moments else F.col(f"`{c}`") for c in df.columns])


def prefix_moments(
    df: DataFrame, sizes: Sequence[int], columns: Sequence[str], *, record_id: str = "record_id"
) -> dict[int, Moments]:
    """The moments of every prefix ``record_id < size`` that has rows, from one scan of the largest.

    A row counts once, in the band of the smallest prefix that holds it; a prefix is the sum
    of its own band and all smaller ones.
    """
    ordered = sorted(set(sizes))
    band = sum((F.when(F.col(record_id) >= s, 1).otherwise(0) for s in ordered[:-1]), F.lit(0))
    bands = gathered(band_moments(df.where(F.col(record_id) < ordered[-1]), columns, band))
    found: dict[int, Moments] = {}
    total: Moments | None = None
    for i, size in enumerate(ordered):
        if i in bands:
            total = bands[i] if total is None else total.plus(bands[i])
        if total is not None:
            found[size] = total
    return found


def nested_prefixes(
    df: DataFrame, sizes: Sequence[int], columns: Sequence[str], *, record_id: str = "record_id"
) -> DataFrame:
    """Every prefix ``record_id < size`` of one table, each scaled on its own statistics.

    All sizes come from one scan for the statistics and one for the rows; the result
    carries a ``size`` column.
    """
    if not sizes or min(sizes) <= 0:
        raise ValueError("sizes must be positive")
    largest = df.where(F.col(record_id) < max(sizes))
    member = F.explode(F.filter(F.array(*[F.lit(s).cast("bigint") for s in sorted(sizes)]), lambda s: F.col(record_id) < s))
    tagged = largest.select(member.alias("size"), "*")
    if not columns:
        return tagged
    per_size = df.sparkSession.createDataFrame(
        [(size, m.columns()) for size, m in prefix_moments(df, sizes, columns, record_id=record_id).items()],
        "size bigint, _moments array<struct<mean double, std double, low double, high double>>",
    )

    def scaled(position: int, c: str) -> Column:
        found = F.col("_moments")[position]
        value = F.col(f"`{c}`").cast("double")
        moving = F.try_divide(value - found["mean"], found["std"])
        return F.when(found["low"] == found["high"], F.lit(0.0)).otherwise(moving).alias(c)

    position = {c: i for i, c in enumerate(columns)}
    return tagged.join(small(per_size, len(sizes)), "size").select(
        "size", *[scaled(position[c], c) if c in position else F.col(f"`{c}`") for c in df.columns]
    )


def prep_summary(
    raw: DataFrame, *, category: str, dropped: str, features: int, expected_rows: int
) -> DataFrame:
    """``(metric, value bigint)``: rows before and after, features, rows per kept class, delta.

    One pass over the raw rows counts every class; the rest follows from the counts.
    """
    counts = raw.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("rows"))
    gone = F.col("category").eqNullSafe(F.lit(dropped))
    entry = F.struct(F.concat(F.lit("rows_"), "category").alias("metric"), F.col("rows").alias("value"))
    totals = counts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum(F.when(gone, F.col("rows"))), F.lit(0)).alias("gone"),
        F.count_if(~gone).alias("classes"),
        F.collect_list(F.when(~gone, entry)).alias("per_class"),  # one entry per class
    )
    final = F.col("raw") - F.col("gone")
    overall = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), value.cast("bigint").alias("value"))
            for name, value in (
                ("rows_raw", F.col("raw")),
                ("rows_dropped", F.col("gone")),
                ("rows_final", final),
                ("features", F.lit(features)),
                ("classes", F.col("classes")),
                ("difference_to_expected", final - expected_rows),
            )
        ]
    )
    return totals.select(F.explode(F.concat(overall, "per_class")).alias("m")).select("m.metric", "m.value")
