"""Mean, deviation and range of many columns from one scan, as vectors that can be added.

A task folds its Arrow batches into one row per band: counts, means, squared deviations from
the mean, and extremes, each a vector over the columns.  Rows are added in two levels, those
of FAN_IN tasks first, always in the order of the tasks, by the exact rule for two sets of
numbers, so nothing is exploded and no sum of squares cancels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VECTORS = "n array<double>, mean array<double>, squares array<double>, low array<double>, high array<double>"
_PARTIAL = f"part int, slot int, band int, {_VECTORS}"
FAN_IN = 256  # tasks whose rows are added in one place first


@dataclass(frozen=True)
class Moments:
    """Of each column: how many values, their mean, squared deviations from it, and extremes."""

    n: np.ndarray
    mean: np.ndarray
    squares: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(values: np.ndarray, missing: np.ndarray | None = None) -> Moments:
        """Of the rows of a matrix; missing values count nowhere."""
        held = np.ones(values.shape, bool) if missing is None else ~missing
        n = held.sum(axis=0).astype(np.float64)
        mean = np.where(held, values, 0.0).sum(axis=0) / np.maximum(n, 1.0)
        gaps = np.where(held, values - mean, 0.0)
        # Rounding of the mean leaves a small sum of gaps, whose square is taken out again.
        squares = np.maximum((gaps * gaps).sum(axis=0) - gaps.sum(axis=0) ** 2 / np.maximum(n, 1.0), 0.0)
        low = np.fmin.reduce(np.where(held, values, np.inf), axis=0)
        return Moments(n, mean, squares, low, np.where(held, values, -np.inf).max(axis=0))

    def plus(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1.0)
        gap = other.mean - self.mean
        return Moments(
            n,
            self.mean + gap * share,
            self.squares + other.squares + gap * gap * self.n * share,
            np.fmin(self.low, other.low),
            np.maximum(self.high, other.high),
        )

    def columns(self) -> list[tuple[float | None, float | None, float | None, float | None]]:
        """``(mean, population deviation, low, high)`` of each column; None without values."""
        deviation = np.sqrt(self.squares / np.maximum(self.n, 1.0))
        rows = np.stack([self.mean, deviation, self.low, self.high], axis=1).tolist()
        return [tuple(row) if n else (None,) * 4 for n, row in zip(self.n, rows)]


_NAMES = [f.name for f in fields(Moments)]


def _batch(keys: list[tuple[int, int, int]], found: list[Moments]) -> pa.RecordBatch:
    whole = [pa.array([key[i] for key in keys], pa.int32()) for i in range(3)]
    vectors = [pa.array([getattr(m, name) for m in found], pa.list_(pa.float64())) for name in _NAMES]
    return pa.RecordBatch.from_arrays([*whole, *vectors], ["part", "slot", "band", *_NAMES])


def _matrix(vectors: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    flat = vectors.flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width) if flat.null_count else None
    return flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width), missing


def _adder(by_slot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add the rows of each band (of each slot), in the order of the parts they come from."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["part"])
        totals: dict[tuple[int, int], Moments] = {}
        for row in rows:
            key = (row["slot"] if by_slot else 0, row["band"])
            moments = Moments(*[np.array(row[name]) for name in _NAMES])
            totals[key] = totals[key].plus(moments) if key in totals else moments
        if totals:
            yield _batch([(slot, slot, band) for slot, band in totals], list(totals.values()))

    return add


def partial_moments(df: DataFrame, columns: Sequence[str], band: Column | None = None) -> DataFrame:
    """The rows of every task, before any are added."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    bands = F.lit(0) if band is None else band.cast("int")
    width, fan_in = len(columns), FAN_IN

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            block, missing = _matrix(batch.column(1), width)
            labels = batch.column(0).to_numpy()
            for label in np.unique(labels).tolist():
                own = slice(None) if label == labels.min() == labels.max() else labels == label
                with np.errstate(invalid="ignore"):  # infinite values have no deviation
                    moments = Moments.of(block[own], None if missing is None else missing[own])
                    totals[label] = totals[label].plus(moments) if label in totals else moments
        if totals:
            task = TaskContext.get().partitionId()
            yield _batch([(task, task // fan_in, label) for label in totals], list(totals.values()))

    return df.select(bands.alias("band"), values.alias("values")).mapInArrow(fold, _PARTIAL)


def band_moments(df: DataFrame, columns: Sequence[str], band: Column | None = None) -> DataFrame:
    """``(band int, n, mean, squares, low, high)``, one row per band with vectors over ``columns``.

    ``band`` (0 for all rows by default) must not be null.  One scan; one row per task and
    band is shuffled, and of these one per FAN_IN tasks a second time.
    """
    by_slot = partial_moments(df, columns, band).repartition("slot").mapInArrow(_adder(True), _PARTIAL)
    by_band = by_slot.repartition("band").mapInArrow(_adder(False), _PARTIAL)
    return by_band.select("band", *_NAMES)


def gathered(moments: DataFrame) -> dict[int, Moments]:
    """By band, on the driver: one row of vectors per band."""
    return {row["band"]: Moments(*[np.array(row[name]) for name in _NAMES]) for row in moments.collect()}
