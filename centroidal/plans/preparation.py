"""KDD preparation as one plan: clean, map, drop, encode, scale, validate, save."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.functions.vectors import pack
from centroidal.operators.layout import written
from centroidal.operators.points import validate_points
from centroidal.operators.prepare import (
    drop_class,
    encode_label,
    map_category,
    normalize_label,
    ordinal_encode,
    prep_summary,
    require_mapped,
    standardize,
)
from centroidal.sources import kdd
from centroidal.sources.writers import save_dataset


@dataclass(frozen=True)
class Prepared:
    points: DataFrame = field(repr=False)
    summary: DataFrame = field(repr=False)


def prepare_table(
    raw: DataFrame,
    *,
    features: Sequence[str],
    categorical: Sequence[str],
    mapping: Mapping[str, str],
    dropped: str,
    label_names: Sequence[str],
    expected_rows: int,
    label: str = "label",
) -> Prepared:
    """Labelled raw records to scaled points ``(features, label bigint)`` and a summary.

    Column order of ``features`` is the order of the vector.  Any further columns of
    ``raw`` (a record id, say) are carried along.
    """
    cleaned = raw.withColumn(label, normalize_label(F.col(label)))
    mapped = require_mapped(map_category(cleaned, label, mapping), label)
    summary = prep_summary(
        mapped,
        category="category",
        dropped=dropped,
        features=len(features),
        expected_rows=expected_rows,
    )
    encoded = ordinal_encode(drop_class(mapped, "category", dropped), categorical)
    scaled = standardize(encoded, features)
    carried = [c for c in raw.columns if c not in {*features, label}]
    points = scaled.select(
        *carried, pack(*features).alias("features"), encode_label(F.col("category"), label_names).alias("label")
    )
    return Prepared(points, summary)


def preprocess_kdd(raw: DataFrame) -> Prepared:
    """Connection records to 41 scaled features and the four kept classes."""
    return prepare_table(
        raw,
        features=kdd.COLUMNS,
        categorical=kdd.CATEGORICAL,
        mapping=kdd.ATTACK_CATEGORY,
        dropped=kdd.DROPPED,
        label_names=kdd.LABELS,
        expected_rows=kdd.PAPER_ROWS,
    )


def prepare_kdd(raw: DataFrame, directory: str, name: str = "kdd99") -> tuple[str, DataFrame]:
    """Preprocess, validate and save; returns the path and the summary table.

    The text is parsed once, into a typed table that the later passes read by column.
    """
    prepared = preprocess_kdd(written(raw, "connections"))
    validate_points(
        prepared.points,
        name=name,
        label="label",
        expected_features=len(kdd.COLUMNS),
        expected_classes=len(kdd.LABELS),
    )
    return save_dataset(prepared.points, name, directory, len(kdd.COLUMNS)), prepared.summary
