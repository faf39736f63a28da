"""k-means of bounded groups, the pool of their centres, and the choice among restarts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.functions.kernels import LocalFit, fit_group, max_shift, to_matrix
from centroidal.functions.keys import hash_bucket, row_key, uniform_array
from centroidal.operators.lloyd import Layout, check_loop_arguments, gather_statistics
from centroidal.operators.packed import keyed, packed
from centroidal.operators.seeding import kmeanspp_seeds

# What one task holds at a time: at most this many rows and this many feature bytes.
GROUP_ROWS = 100_000
GROUP_BYTES = 64 << 20

_CHUNK_STEP = 1 << 31
_SUBDIVISION = 1 << 20  # number of the draw that places a record in a part of its bucket
_LOCAL = (
    "bucket bigint, record_count bigint, centers array<array<double>>,"
    " iterations int, converged boolean, sse double, distinct_keys bigint"
)
_RESTART = (
    "seed bigint, record_count bigint, centers array<array<double>>, cluster_counts array<bigint>,"
    " iterations int, converged boolean, sse double"
)


def check_fit_arguments(k: int, max_iterations: int, tolerance: float) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
    check_loop_arguments(max_iterations, tolerance)


def suggested_buckets(rows: int, k: int, dimensions: int) -> int:
    """As many buckets as keep each within the group bounds and far above k rows."""
    fitting = min(GROUP_ROWS, max(1, GROUP_BYTES // (8 * dimensions)))
    return max(1, min(-(-rows // fitting), rows // (32 * k)))


def _require_rows(name: str, rows: int, k: int, advice: str = "") -> None:
    if rows < k:
        raise ValueError(f"{name} has {rows} records, fewer than k={k}{advice}")


def _result_columns(records: int, fit: LocalFit) -> dict[str, pa.Array]:
    return {
        "record_count": pa.array([records], pa.int64()),
        "centers": pa.array([fit.centers.tolist()], pa.list_(pa.list_(pa.float64()))),
        "iterations": pa.array([fit.iterations], pa.int32()),
        "converged": pa.array([fit.converged], pa.bool_()),
        "sse": pa.array([fit.sse], pa.float64()),
    }


def _group_row(group: int, keys: np.ndarray, block: np.ndarray, fit: LocalFit) -> dict[str, pa.Array]:
    return {
        "bucket": pa.array([group], pa.int64()),
        **_result_columns(len(block), fit),
        "distinct_keys": pa.array([len(np.unique(keys))], pa.int64()),
    }


def partition_kmeans(
    points: DataFrame,
    k: int,
    *,
    n_buckets: int | None = None,
    max_iterations: int = 100,
    tolerance: float = 1e-6,
    random_seed: int = 42,
    group_rows: int | None = None,
    subdivide: bool = False,
) -> DataFrame:
    """One row per non-empty group with the k centres of its own k-means.

    ``n_buckets=None`` fits every partition where it lies: no shuffle.  A partition of
    more than ``group_rows`` rows (by default what the group bounds allow) gives several
    groups, cut after exactly so many rows; the last has at least k.  With ``n_buckets``
    the groups are hash buckets of the record id, which costs one shuffle of the
    features and makes the result independent of the physical layout.  A bucket of more
    than ``group_rows`` rows is an error, unless ``subdivide`` is set: then it is cut into as
    few groups as the bounds allow by a second hash of the id, which is independent of the
    layout as well; group g of a bucket is numbered ``bucket + g * 2^31``.  A group of fewer
    than k records is an error naming the group.

    ``distinct_keys`` counts the different record ids of a group, by their keys; equal ids
    share a bucket, so buckets whose counts add up to the records hold no id twice.
    """
    check_fit_arguments(k, max_iterations, tolerance)
    if n_buckets is None:
        return _fit_partitions(points, k, max_iterations, tolerance, random_seed, group_rows)
    if n_buckets <= 0:
        raise ValueError("the number of buckets must be positive")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition holds one bucket, so it is that bucket.
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bucket = table.column("bucket")[0].as_py()
        _require_rows(f"bucket {bucket}", table.num_rows, k)
        for number, keys, block in parts(bucket, table.column("key").to_numpy(), to_matrix(table.column("features"))):
            _require_rows(f"part {number} of bucket {bucket}", len(block), k)
            group = bucket + number * _CHUNK_STEP
            found = fit_group(block, keys, k, max_iterations, tolerance, random_seed + group)
            yield pa.RecordBatch.from_pydict(_group_row(group, keys, block, found))

    def parts(bucket: int, keys: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        limit = group_rows or min(GROUP_ROWS, max(1, GROUP_BYTES // (8 * block.shape[1])))
        if len(block) <= limit:
            yield 0, keys, block
            return
        if not subdivide:
            raise ValueError(
                f"bucket {bucket} has {len(block)} records of {block.shape[1]} features, more than one task should hold;"
                " use more buckets (see suggested_buckets) or subdivide them"
            )
        n = -(-len(block) // limit)
        part = np.minimum((uniform_array(keys, random_seed, _SUBDIVISION) * n).astype(np.int64), n - 1)
        for number in range(n):
            yield number, keys[part == number], block[part == number]

    record_id = F.col("record_id")
    bucketed = points.select(hash_bucket(record_id, n_buckets).alias("bucket"), row_key(record_id).alias("key"), "features")
    return bucketed.repartitionById(n_buckets, F.col("bucket")).mapInArrow(fit, _LOCAL)


def _fit_partitions(
    points: DataFrame, k: int, max_iterations: int, tolerance: float, random_seed: int, group_rows: int | None
) -> DataFrame:
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()

        def result(number: int, keys: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
            group = partition + number * _CHUNK_STEP
            found = fit_group(block, keys, k, max_iterations, tolerance, random_seed + group)
            return pa.RecordBatch.from_pydict(_group_row(group, keys, block, found))

        number, held_keys, held, rows = 0, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            block = to_matrix(batch.column(1))
            if held and block.shape[1] != held[0].shape[1]:
                raise ValueError("points have different numbers of features")
            limit = max(group_rows or min(GROUP_ROWS, GROUP_BYTES // (8 * block.shape[1])), k)
            held_keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            held.append(block)
            rows += len(block)
            # A full group is only closed once k further rows are known to follow.
            while rows >= limit + k:
                all_keys, all_rows = np.concatenate(held_keys), np.concatenate(held)
                yield result(number, all_keys[:limit], all_rows[:limit])
                number, held_keys, held, rows = number + 1, [all_keys[limit:]], [all_rows[limit:]], rows - limit
        if rows:
            _require_rows(f"partition {partition}", rows, k, "; use n_buckets or fewer partitions")
            yield result(number, np.concatenate(held_keys), np.concatenate(held))

    return keyed(points).mapInArrow(fit, _LOCAL)


def collect_candidates(local: DataFrame) -> DataFrame:
    """``(bucket, cluster int, features, record_count, record_id)``: every local centre as a point."""
    flat = local.select("bucket", "record_count", F.size("centers").alias("k"), F.posexplode("centers"))
    return flat.select(
        "bucket",
        F.col("pos").alias("cluster"),
        F.col("col").alias("features"),
        "record_count",
        (F.col("bucket") * F.col("k") + F.col("pos")).alias("record_id"),
    )


@dataclass(frozen=True)
class SeededFit:
    """k-means of one table from one seed."""

    seed: int
    centers: np.ndarray
    cluster_counts: tuple[int, ...]
    iterations: int
    converged: bool
    sse: float


def fits_one_group(rows: int, dimensions: int) -> bool:
    return rows <= GROUP_ROWS and rows * dimensions * 8 <= GROUP_BYTES


def restart_table(
    points: DataFrame, k: int, seeds: list[int], max_iterations: int = 100, tolerance: float = 1e-6
) -> DataFrame:
    """k-means of one bounded table from each seed, one task per seed.

    Only for tables within the group bounds (see ``fits_one_group``).
    """
    check_fit_arguments(k, max_iterations, tolerance)

    def fit(key: tuple[pa.Scalar], group: pa.Table) -> pa.Table:
        seed = seeds[key[0].as_py()]
        _require_rows("the table", group.num_rows, k)
        block = to_matrix(group.column("features"))
        found = fit_group(block, group.column("key").to_numpy(), k, max_iterations, tolerance, seed)
        counts = pa.array([found.counts.tolist()], pa.list_(pa.int64()))
        columns = {"seed": pa.array([seed], pa.int64()), **_result_columns(len(block), found)}
        return pa.table({**columns, "cluster_counts": counts}).select(_names(_RESTART))

    copies = keyed(points).select(F.explode(F.sequence(F.lit(0), F.lit(len(seeds) - 1))).alias("run"), "key", "features")
    return copies.repartitionById(len(seeds), F.col("run")).groupBy("run").applyInArrow(fit, _RESTART)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def fit_seeds(
    points: DataFrame,
    k: int,
    seeds: list[int],
    *,
    rows: int,
    dimensions: int,
    max_iterations: int = 100,
    tolerance: float = 1e-6,
    distributed: bool | None = None,
) -> list[SeededFit]:
    """k-means of one table from each of r seeds, in seed order.

    A table within the group bounds is fitted by one task per seed; any larger one
    by batched distributed rounds in which each scan serves all seeds.  Both follow
    the same definition and agree up to rounding; ``distributed=True`` asks for the rounds
    whatever the size.
    """
    check_fit_arguments(k, max_iterations, tolerance)
    if not seeds:
        raise ValueError("at least one initialization is required")
    _require_rows("the table", rows, k)
    if not distributed and fits_one_group(rows, dimensions):
        found = restart_table(points, k, seeds, max_iterations, tolerance).collect()  # one row per seed
        by_seed = {row["seed"]: row for row in found}
        return [
            SeededFit(
                s,
                np.array(by_seed[s]["centers"]),
                tuple(by_seed[s]["cluster_counts"]),
                by_seed[s]["iterations"],
                by_seed[s]["converged"],
                by_seed[s]["sse"],
            )
            for s in seeds
        ]
    with packed(points, with_keys=True, rows=rows, dimensions=dimensions) as blocks:
        return _fit_seeds_distributed(blocks, k, seeds, max_iterations, tolerance)


def _fit_seeds_distributed(
    blocks: DataFrame, k: int, seeds: list[int], max_iterations: int, tolerance: float
) -> list[SeededFit]:
    models = kmeanspp_seeds(blocks, k, seeds)
    iterations = np.zeros(len(seeds), dtype=int)
    converged = np.zeros(len(seeds), dtype=bool)
    layout = Layout()
    while True:
        active = np.flatnonzero(~converged & (iterations < max_iterations))
        if not len(active):
            break
        for run, statistics in zip(active, gather_statistics(blocks, models[active], layout=layout)):
            moved = statistics.means(models[run])
            converged[run] = max_shift(models[run], moved) <= tolerance
            models[run] = moved
            iterations[run] += 1
    final = gather_statistics(blocks, models, with_sums=False, layout=layout)
    return [
        SeededFit(
            seed,
            models[run],
            tuple(int(n) for n in final[run].counts),
            int(iterations[run]),
            bool(converged[run]),
            float(final[run].sse.sum()),
        )
        for run, seed in enumerate(seeds)
    ]


def best_of(fits: list[SeededFit], tie_width: float = 0.0) -> SeededFit:
    """Lowest squared error; the first of equals.

    Runs that reach the same optimum can differ in the last bits of their error with the
    order of summation.  ``tie_width`` is the relative difference up to which errors count
    as equal; by default only equal numbers do.
    """
    if not fits:
        raise ValueError("no runs to choose from")
    lowest = min(fit.sse for fit in fits)
    return next(fit for fit in fits if fit.sse <= lowest * (1 + tie_width))


def best_run(runs: DataFrame, error: str = "sse", order: str = "run") -> DataFrame:
    """The row of lowest error, the lowest ``order`` on ties; one aggregate, no sort."""
    whole = F.struct(*[F.col(f"`{c}`") for c in runs.columns])
    return runs.agg(F.min_by(whole, F.struct(F.col(error), F.col(order))).alias("best")).select("best.*")


def aggregate_candidates(
    candidates: DataFrame,
    k: int,
    *,
    rows: int,
    dimensions: int,
    num_restarts: int = 1,
    max_iterations: int = 100,
    tolerance: float = 1e-6,
    random_seed: int = 42,
    tie_width: float = 0.0,
) -> SeededFit:
    """Re-cluster the unweighted candidates from consecutive seeds and keep the best (see ``best_of``)."""
    if num_restarts <= 0:
        raise ValueError("the number of restarts must be positive")
    if rows < k:
        raise ValueError(f"{rows} candidate centers are fewer than k={k}")
    seeds = [random_seed + restart for restart in range(num_restarts)]
    return best_of(
        fit_seeds(
            candidates,
            k,
            seeds,
            rows=rows,
            dimensions=dimensions,
            max_iterations=max_iterations,
            tolerance=tolerance,
        ),
        tie_width,
    )
