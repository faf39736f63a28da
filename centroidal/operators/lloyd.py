"""Distributed Lloyd iterations: one scan and one small shuffle per round.

Each task folds its Arrow batches into k rows, one vector of sums per cluster.  The rows
are added in two levels, first those of FAN_IN tasks, then what is left of each cluster, and
only the k new centres reach the driver.
Every round starts from plain arrays, so lineage does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centroidal.functions.kernels import Statistics, max_shift, nearest, sums_by, to_matrix
from centroidal.operators.assign import Centers, as_centers, centers_frame
from centroidal.operators.packed import features_of, matrices, packed

_PARTIAL = "part int, slot int, cluster int, n bigint, sse double, sums array<double>"
FAN_IN = 256  # tasks whose partial statistics are added in one place first
DRIVER_SLOTS = 16  # slots whose rows the driver can add itself


@dataclass
class Layout:
    """What rounds over one table learn from each other: how many slots its tasks fill."""

    slots: int | None = None


def _partial_batch(
    part: int, slot: int | np.ndarray, clusters: np.ndarray, n: np.ndarray, sse: np.ndarray, sums: np.ndarray
) -> pa.RecordBatch:
    rows, width = sums.shape
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.broadcast_to(np.asarray(part, np.int32), rows)),
            pa.array(np.broadcast_to(np.asarray(slot, np.int32), rows)),
            pa.array(clusters.astype(np.int32)),
            pa.array(n.astype(np.int64)),
            pa.array(sse.astype(np.float64)),
            pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(sums.ravel())),
        ],
        names=["part", "slot", "cluster", "n", "sse", "sums"],
    )


def _task_batch(fan_in: int, clusters: np.ndarray, n: np.ndarray, sse: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """What a task adds up: one row per cluster that has members in it."""
    task = TaskContext.get().partitionId()
    held = n > 0
    return _partial_batch(task, task // fan_in, clusters[held], n[held], sse[held], sums[held])


def _adder(by_slot: bool):
    """Add the rows of each cluster (of each slot), in the order of the parts they come from."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        part, slot, cluster, n, sse = (table.column(i).to_numpy() for i in range(5))
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(len(part), -1)
        group = slot if by_slot else np.zeros_like(slot)
        order = np.lexsort((part, cluster, group))
        cluster, group = cluster[order], group[order]
        starts = np.flatnonzero(np.r_[True, (cluster[1:] != cluster[:-1]) | (group[1:] != group[:-1])])
        added = [np.add.reduceat(x[order], starts, axis=0) for x in (n, sse, sums)]
        highest = np.maximum.reduceat(slot[order], starts)
        yield _partial_batch(highest, highest, cluster[starts], *added)

    return add


def _by_slot(partials: DataFrame) -> DataFrame:
    return partials.repartition("slot").mapInArrow(_adder(True), _PARTIAL)


def _by_cluster(slots: DataFrame) -> DataFrame:
    return slots.repartition("cluster").mapInArrow(_adder(False), _PARTIAL)


def _merged(partials: DataFrame) -> DataFrame:
    """``(cluster, n, sse, sums)``: partial rows added in two levels.

    A slot adds the rows of FAN_IN tasks, so the last exchange moves one row per slot and
    cluster whatever the number of tasks.  The order of every addition is fixed.
    """
    return _by_cluster(_by_slot(partials)).select("cluster", "n", "sse", "sums")


def _task_statistics(points: DataFrame, models: np.ndarray, with_sums: bool) -> DataFrame:
    """The partial rows of every task, before any are added."""
    runs, k, dimensions = models.shape
    fan_in = FAN_IN

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [Statistics.empty(k, dimensions) for _ in range(runs)]
        for block in (block for batch in batches for block in matrices(batch)):
            for model, total in zip(models, totals):
                labels, distances = nearest(block, model)
                total.add(block, labels, distances)
        sums = np.concatenate([t.sums for t in totals])
        yield _task_batch(
            fan_in,
            np.arange(runs * k),
            np.concatenate([t.counts for t in totals]),
            np.concatenate([t.sse for t in totals]),
            sums if with_sums else sums[:, :0],
        )

    return features_of(points).mapInArrow(fold, _PARTIAL)


def partial_statistics(points: DataFrame, models: np.ndarray, with_sums: bool = True) -> DataFrame:
    """``(cluster, n, sse, sums)`` of the non-empty clusters of r models, from one scan.

    ``models`` is (r, k, d); cluster ``run * k + i`` is centre i of a run.  Without sums the
    arrays are empty.
    """
    return _merged(_task_statistics(points, models, with_sums))


def gather_statistics(
    points: DataFrame, models: np.ndarray, with_sums: bool = True, layout: Layout | None = None
) -> list[Statistics]:
    """Statistics of each of r models; k * (d + 2) numbers per model reach the driver.

    Rounds over one table share a ``layout``: once it says that there are few slots, the
    driver adds their rows itself, in the same order, which saves the last exchange.
    """
    runs, k, dimensions = models.shape
    slots = _by_slot(_task_statistics(points, models, with_sums))
    if layout and layout.slots is not None and layout.slots <= DRIVER_SLOTS:
        rows = slots.toArrow()
        table = pa.Table.from_batches(_adder(False)(iter(rows.to_batches()))) if rows.num_rows else rows
    else:
        table = _by_cluster(slots).toArrow()
        if layout and table.num_rows:
            layout.slots = int(table.column("slot").to_numpy().max()) + 1
    if not table.num_rows:
        raise ValueError("the point table must not be empty")
    cluster = table.column("cluster").to_numpy()
    counts, errors = np.zeros(runs * k, dtype=np.int64), np.zeros(runs * k)
    sums = np.zeros((runs * k, dimensions))
    counts[cluster] = table.column("n").to_numpy()
    errors[cluster] = table.column("sse").to_numpy()
    if with_sums:
        sums[cluster] = to_matrix(table.column("sums"))
    if not np.isfinite(errors).all():
        raise ValueError("features contain NaN or infinite values")
    return [
        Statistics(part, error, total)
        for part, error, total in zip(
            counts.reshape(runs, k), errors.reshape(runs, k), sums.reshape(runs, k, dimensions)
        )
    ]


def cluster_statistics(points: DataFrame, centers: Centers) -> DataFrame:
    """``(cluster int, n bigint, sse double, sums array<double>)`` of non-empty clusters."""
    return partial_statistics(points, as_centers(centers)[None])


def cluster_means(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``(cluster int, n bigint, center array<double>)``: mean of the points of each given id."""
    fan_in = FAN_IN

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            block = to_matrix(batch.column(1))
            ids, labels = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            rows = np.column_stack([np.bincount(labels), sums_by(labels, block, len(ids))])
            for key, row in zip(ids.tolist(), rows):
                totals[key] = totals[key] + row if key in totals else row
        if totals:
            rows = np.stack(list(totals.values()))
            yield _task_batch(fan_in, np.fromiter(totals, dtype=np.int64), rows[:, 0], np.zeros(len(rows)), rows[:, 1:])

    summed = _merged(points.select(F.col(cluster).cast("int"), "features").mapInArrow(fold, _PARTIAL))
    return summed.select("cluster", "n", F.transform("sums", lambda s: s / F.col("n")).alias("center"))


def keep_empty(means: DataFrame, previous: Centers) -> DataFrame:
    """New centres for every previous id: its mean, or the previous centre with count 0."""
    old = centers_frame(means.sparkSession, previous).withColumnRenamed("center", "previous")
    return old.join(means, "cluster", "left").select(
        "cluster",
        F.coalesce("center", "previous").alias("center"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def max_center_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row ``max_center_shift``: largest squared movement between two centre tables."""
    before = old.select("cluster", F.col("center").alias("before"))
    after = new.select("cluster", F.col("center").alias("after"))
    gaps = F.zip_with("before", "after", lambda a, b: (a - b) * (a - b))
    moved = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)
    paired = before.join(after, "cluster", "full")
    matched = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.size("before") == F.size("after"))
    checked = F.when(matched, moved).otherwise(
        F.raise_error(F.lit("old and new centers must match in ids and length")).cast("double")
    )
    top = F.max(checked)
    empty = F.raise_error(F.lit("at least one center is required")).cast("double")
    return paired.agg(F.when(F.count(F.lit(1)) > 0, top).otherwise(empty).alias("max_center_shift"))


@dataclass(frozen=True)
class Step:
    """One Lloyd round; ``sse`` and ``counts`` refer to the centres before the update."""

    centers: np.ndarray
    counts: tuple[int, ...]
    sse: float
    max_center_shift: float


def _step(statistics: Statistics, centers: np.ndarray) -> Step:
    moved = statistics.means(centers)
    counts = tuple(int(n) for n in statistics.counts)
    return Step(moved, counts, float(statistics.sse.sum()), max_shift(centers, moved))


def lloyd_step(points: DataFrame, centers: Centers, layout: Layout | None = None) -> Step:
    """Assign, re-average and measure in one job; empty clusters keep their centre."""
    model = as_centers(centers)
    return _step(gather_statistics(points, model[None], layout=layout)[0], model)


@dataclass(frozen=True)
class LloydModel:
    """Centres with the error and counts measured against exactly these centres."""

    centers: np.ndarray
    iterations: int
    converged: bool
    sse: float
    cluster_counts: tuple[int, ...]
    history: tuple[Step, ...] = field(repr=False)

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return history_frame(spark, self.history)


def history_frame(spark: SparkSession, history: tuple[Step, ...]) -> DataFrame:
    """``(iteration, sse, max_center_shift, cluster_counts)``, one row per round."""
    rows = [(i, s.sse, s.max_center_shift, list(s.counts)) for i, s in enumerate(history, 1)]
    return spark.createDataFrame(
        rows, "iteration int, sse double, max_center_shift double, cluster_counts array<bigint>"
    )


def check_loop_arguments(max_iterations: int, tolerance: float | None) -> None:
    if max_iterations <= 0:
        raise ValueError("the iteration limit must be positive")
    if tolerance is not None and not tolerance >= 0:
        raise ValueError("the tolerance cannot be negative")


def _settled(previous: float, current: float, tolerance: float, relative: float = 0.0) -> bool:
    return abs(current - previous) <= max(tolerance, relative * max(abs(previous), abs(current)))


def iterate(
    points: DataFrame, initial: Centers, max_iterations: int, tolerance: float | None, relative_tolerance: float = 0.0
) -> tuple[list[Step], bool]:
    """Rounds until the error settles, and whether it did."""
    check_loop_arguments(max_iterations, tolerance)
    centers = as_centers(initial)
    history: list[Step] = []
    converged = False
    layout = Layout()
    while len(history) < max_iterations and not converged:
        step = lloyd_step(points, centers, layout)
        if tolerance is not None and history:
            converged = _settled(history[-1].sse, step.sse, tolerance, relative_tolerance)
        history.append(step)
        centers = step.centers
    return history, converged


def finish(points: DataFrame, history: list[Step], converged: bool) -> LloydModel:
    """Measure the last centres; when the last round moved nothing it already did."""
    last = history[-1]
    if last.max_center_shift == 0.0:
        error, counts = last.sse, last.counts
    else:
        error, counts = measure_centers(points, last.centers)
    return LloydModel(last.centers, len(history), converged, error, counts, tuple(history))


def lloyd_fit(
    points: DataFrame,
    initial: Centers,
    *,
    max_iterations: int = 100,
    tolerance: float | None = 1e-6,
    relative_tolerance: float = 0.0,
) -> LloydModel:
    """Rounds until the change in squared error is at most ``tolerance``.

    A table of very many rows may never meet an absolute tolerance, as the error's own
    rounding is larger; ``relative_tolerance`` (off by default) also accepts a change of
    that share of the error.

    Two rounds are needed to see a change, so one round never converges.
    ``tolerance=None`` runs exactly ``max_iterations`` rounds.  ``points`` is read once; the
    rounds read its features from cached blocks (see ``packed``).
    """
    with packed(points) as blocks:
        return finish(blocks, *iterate(blocks, initial, max_iterations, tolerance, relative_tolerance))


def measure_centers(points: DataFrame, centers: Centers) -> tuple[float, tuple[int, ...]]:
    """Total squared error and cluster counts of fixed centres, from one scan."""
    found = gather_statistics(points, as_centers(centers)[None], with_sums=False)[0]
    return float(found.sse.sum()), tuple(int(n) for n in found.counts)
