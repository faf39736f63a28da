"""Helpers that the corpus operators share: columns, batches of texts, words, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from centroidal.operators.layout import written

__all__ = [
    "ASCII_LOWER",
    "documents",
    "ids_and_texts",
    "quoted",
    "remainder",
    "sole_memory",
    "table",
    "text_slices",
    "text_version",
    "unused",
    "written",
]

# Bytes as they are, but A-Z in lower case.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Most text held as Python objects at once, in characters.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only ``(doc_id bigint, text string)``, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_version(text: Column) -> Column:
    """A 64-bit hash that tells texts with the same id from one another; null has one of its own."""
    return F.xxhash64(F.lit("version"), text.isNull(), text.cast("string"))


def quoted(name: str) -> str:
    """A column name as it is, whatever it contains."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not among ``columns``, however Spark compares them."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


_REMEMBERED: dict[str, Callable[[], object]] = {}


def sole_memory(owner: str, forget: Callable[[], object]) -> None:
    """Say that this worker remembers words for ``owner``; what it remembers for others is forgotten.

    Python workers live longer than a stage, and what one operator has remembered would
    add to what the next one does.
    """
    for other in [o for o in _REMEMBERED if o != owner]:
        _REMEMBERED.pop(other)()
    _REMEMBERED[owner] = forget


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, end row, texts) of consecutive rows with a bounded amount of text."""
    texts = batch.column(column)
    start = 0
    held: list[str | None] = []
    chars = 0
    for row in range(batch.num_rows):
        text = texts[row].as_py()
        held.append(text)
        chars += len(text or "")
        if chars >= SLICE_CHARS:
            yield start, row + 1, held
            start, held, chars = row + 1, [], 0
    if held:
        yield start, batch.num_rows, held
