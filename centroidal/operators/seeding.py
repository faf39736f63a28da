"""k-means++ seeding over a whole distributed table, for several seeds at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.functions.kernels import lowest, nearest, to_matrix
from centroidal.functions.keys import uniform, uniform_array
from centroidal.operators.layout import written
from centroidal.operators.packed import keyed, keyed_matrices

_OFFER = "run int, rank int, score double, key bigint, features array<double>"
_STATE = "key bigint, features array<double>, spread array<double>"
REFRESH = 16  # draws after which the distances to the chosen rows are kept with the rows
LINEAGE = 4  # kept states after which one is written, so that lineage stays short
_TAKEN = -1.0  # in place of the distance of a chosen row

# Keys and rows that were chosen for one run.
Chosen = tuple[np.ndarray, np.ndarray]


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def _spread(batch: pa.RecordBatch, recent: Sequence[Chosen]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, rows and (r, n) squared distances to the nearest chosen row, measured against ``recent`` ones only."""
    known = to_matrix(batch.column("spread")).T if "spread" in batch.schema.names and batch.num_rows else None
    for keys, block in keyed_matrices(batch):
        spread = np.full((len(recent), len(keys)), np.inf) if known is None else np.array(known, order="C")
        for own, (chosen, rows) in zip(spread, recent):
            if len(rows):
                np.copyto(own, np.minimum(own, nearest(block, rows)[1]), where=own != _TAKEN)
                own[np.isin(keys, chosen)] = _TAKEN
        yield keys, block, spread


def _offers(draw: int, seeds: list[int], recent: Sequence[Chosen]):
    """Best row of each task for each run; rank 1 marks the fallback for all-zero distances."""

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for keys, block, spread in (found for batch in batches for found in _spread(batch, recent)):
            for run, (seed, own) in enumerate(zip(seeds, spread)):
                u = uniform_array(keys, seed, draw)
                if draw == 0:
                    offers = [(0, own != _TAKEN, u)]
                else:
                    ahead = own > 0
                    score = -np.log(u) / np.where(ahead, own, 1.0)
                    offers = [(0, ahead, score), (1, ~ahead & (own != _TAKEN), u)]
                for rank, eligible, score in offers:
                    rows = np.flatnonzero(eligible)
                    if not len(rows):
                        continue
                    row = rows[lowest(score[rows], keys[rows])]
                    offer = (rank, float(score[row]), int(keys[row]))
                    if run not in best or offer < best[run][0]:
                        best[run] = (offer, block[row].copy())
                    break
        if best:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(best), pa.int32()),
                    pa.array([offer[0] for offer, _ in best.values()], pa.int32()),
                    pa.array([offer[1] for offer, _ in best.values()], pa.float64()),
                    pa.array([offer[2] for offer, _ in best.values()], pa.int64()),
                    pa.array([vector.tolist() for _, vector in best.values()], pa.list_(pa.float64())),
                ],
                names=["run", "rank", "score", "key", "features"],
            )

    return race


def _kept(recent: Sequence[Chosen]):
    """The rows with their distances, brought up to date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block, spread in (found for batch in batches for found in _spread(batch, recent)):
            columns = [pa.array(keys), _lists(block), _lists(spread.T)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "features", "spread"])

    return run


class _States:
    """The rows and what is known of their distances; the newest kept state and the one before it are cached."""

    def __init__(self, points: DataFrame, seeds: list[int]):
        self.source, self.seeds, self.kept = keyed(points), seeds, 0
        self.current = self.source
        self.cached: list[DataFrame] = []

    def keep(self, recent: Sequence[Chosen]) -> DataFrame:
        state = self.current.mapInArrow(_kept(recent), _STATE)
        self.kept += 1
        if self.kept % LINEAGE == 0:
            state = written(state, "seeding")
        self.current = state.persist(StorageLevel.MEMORY_AND_DISK)
        self.cached.append(self.current)
        return self.current

    def winners(self, draw: int, recent: Sequence[Chosen], k: int) -> list[Chosen]:
        """The winning row of each run; one row per seed reaches the driver."""
        found = (
            self.current.mapInArrow(_offers(draw, self.seeds, recent), _OFFER)
            .groupBy("run")
            .agg(F.min_by(F.struct("key", "features"), F.struct("rank", "score", "key")).alias("row"))
            .collect()
        )
        if len(found) < len(self.seeds):
            raise ValueError(f"k={k} exceeds the number of points")
        self.settle()
        rows = [w["row"] for w in sorted(found, key=lambda w: w["run"])]
        return [(np.array([row["key"]]), np.array([row["features"]])) for row in rows]

    def settle(self) -> None:
        """Once a state is computed, the one before it is not needed."""
        while len(self.cached) > 1:
            self.cached.pop(0).unpersist()

    def release(self) -> None:
        while self.cached:
            self.cached.pop().unpersist()


def _check(k: int, seeds: Sequence[int]) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
    if not seeds:
        raise ValueError("at least one seed is required")


def _joined(parts: Sequence[Sequence[Chosen]], runs: int) -> list[Chosen]:
    """What was chosen in several steps, by run."""
    if not parts:
        return [(np.empty(0, np.int64), np.empty((0, 0)))] * runs
    return [tuple(np.concatenate([step[run][i] for step in parts]) for i in (0, 1)) for run in range(runs)]


def kmeanspp_seeds(points: DataFrame, k: int, seeds: Sequence[int]) -> np.ndarray:
    """(r, k, d) starting centres, one k-means++ sequence per seed.

    A draw is an exponential race: each task offers its best row per run and Spark keeps the
    lowest, so one scan per draw serves every seed and no row order or running total is
    involved.  Every REFRESH draws the rows are kept with their distance to the nearest
    chosen row, so a draw measures them against at most REFRESH rows, however large k is.
    ``points`` may be packed with keys.
    """
    _check(k, seeds)
    runs = len(seeds)
    states = _States(points, list(seeds))
    chosen: list[list[Chosen]] = []
    recent = 0  # of the chosen rows, since distances were last kept
    try:
        for draw in range(k):
            if recent == REFRESH:
                states.keep(_joined(chosen[-recent:], runs))
                recent = 0
            newest = chosen[len(chosen) - recent :]
            chosen.append(states.winners(draw, _joined(newest, runs), k))
            recent += 1
    finally:
        states.release()
    return np.stack([rows for _, rows in _joined(chosen, runs)])


def oversampled_seeds(
    points: DataFrame, k: int, seeds: Sequence[int], *, rounds: int = 5, oversampling: float | None = None
) -> np.ndarray:
    """(r, k, d) starting centres from few scans, however large k is.

    After one first row, every round takes each row with probability ``oversampling * d2 / sum(d2)``
    (2k by default), independently, so about so many rows of a round reach the driver.  The
    rows taken are weighted by the number of points nearest to them, and a weighted
    k-means++ race among them gives the centres; should a run have taken fewer than k, all
    get plain k-means++ draws.  All draws are functions of seed and record id.
    """
    _check(k, seeds)
    if rounds <= 0 or (oversampling is not None and oversampling <= 0):
        raise ValueError("rounds and oversampling must be positive")
    wanted = 2.0 * k if oversampling is None else oversampling
    runs = range(len(seeds))
    states = _States(points, list(seeds))
    try:
        newest = states.winners(0, _joined([], len(seeds)), k)
        taken = [[pair] for pair in newest]
        for draw in range(1, rounds + 1):
            state = states.keep(newest)
            open_ = [F.greatest(F.col("spread")[i], F.lit(0.0)) for i in runs]
            totals = state.agg(*[F.sum(d) for d in open_]).first()
            states.settle()
            chance = [
                (F.col("spread")[i] > 0)
                & (uniform(F.col("key"), seeds[i], draw) * F.lit(totals[i] or 0.0) < F.lit(wanted) * F.col("spread")[i])
                for i in runs
            ]
            hits = F.array(*chance)
            rows = state.filter(F.exists(hits, lambda hit: hit)).select("key", "features", hits.alias("hits")).collect()
            rows.sort(key=lambda row: row["key"])
            newest = []
            for i in runs:
                own = [row for row in rows if row["hits"][i]]
                newest.append((np.array([r["key"] for r in own], np.int64), np.array([r["features"] for r in own])))
                if own:
                    taken[i].append(newest[i])
        pools = [tuple(np.concatenate(parts) for parts in zip(*own)) for own in taken]
        weights = _weights(states.source, [rows for _, rows in pools])
    finally:
        states.release()
    if any(len(rows) < k for _, rows in pools):
        return kmeanspp_seeds(points, k, seeds)
    return np.stack([_weighted_race(*pool, weight, k, seed) for pool, weight, seed in zip(pools, weights, seeds)])


def _weights(source: DataFrame, pools: list[np.ndarray]) -> list[np.ndarray]:
    """How many points are nearest to each row of each pool, the first of equals, from one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(pool), np.int64) for pool in pools]
        for batch in batches:
            if batch.num_rows:
                block = to_matrix(batch.column(0))
                for own, pool in zip(counts, pools):
                    own += np.bincount(nearest(block, pool)[0], minlength=len(pool))
        for i, own in enumerate(counts):
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["run", "place", "n"]
            )

    counted = source.select("features").mapInArrow(run, "run int, place int, n bigint").groupBy("run", "place").agg(F.sum("n").alias("n"))
    found = [np.zeros(len(pool)) for pool in pools]
    for row in counted.collect():  # one row for each row of the pools
        found[row["run"]][row["place"]] = row["n"]
    return found


def _weighted_race(keys: np.ndarray, rows: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ among weighted rows: the lowest ``-ln(u) / (weight * d2)`` wins; rows of no weight come last."""
    chosen: list[int] = []
    spread = np.ones(len(rows))
    for draw in range(k):
        u = uniform_array(keys, seed, draw)
        free = ~np.isin(np.arange(len(rows)), chosen)
        mass = weights * spread
        ahead = free & (mass > 0)
        score = np.where(ahead, -np.log(u) / np.where(ahead, mass, 1.0), np.where(free, u, np.inf))
        rank = np.where(ahead, 0, np.where(free, 1, 2))
        winner = int(np.lexsort((keys, score, rank))[0])
        chosen.append(winner)
        distance = nearest(rows, rows[winner : winner + 1])[1]
        spread = distance if draw == 0 else np.minimum(spread, distance)
    return rows[chosen]
