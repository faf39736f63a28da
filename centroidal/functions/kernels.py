"""NumPy kernels that run inside Spark tasks on one Arrow batch or one bounded group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from centroidal.functions.keys import uniform_array

# Ranks held at a time, so that they stay in the processor cache.
_BLOCK_BYTES = 1 << 20
# Up to this many clusters a product with the membership matrix beats counting by column.
_ONE_HOT_LIMIT = 16
# Margin for the rounding of accumulated distance bounds.
_SURE = 1.0 + 1e-9


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """``list<double>`` column to an (n, d) float64 array; nulls and ragged rows raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if column.null_count:
        raise ValueError("features contain null vectors")
    if rows == 0:
        return np.empty((0, 0))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    dimensions = int(lengths[0])
    if dimensions == 0:
        raise ValueError("points must have at least one feature")
    if (lengths != dimensions).any():
        raise ValueError("points have different numbers of features")
    values = column.flatten()
    if values.null_count:
        raise ValueError("features contain null values")
    return np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(rows, dimensions)


def _distances_to(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.einsum("ij,ij->i", gap, gap)


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (lowest index on ties) and its squared distance."""
    labels = nearest_labels(points, centers)
    return labels, _distances_to(points, centers.take(labels, axis=0))


def nearest_labels(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest centre, lowest index on ties."""
    return _two_nearest(points, centers)[0]


def _two_nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre, an upper bound of its distance and a lower bound of any other's.

    One matrix product ranks the centres.  Rows whose best two centres lie within the
    rounding bound of that product are measured directly, so the answer is always
    that of the direct formula.
    """
    rows, dimensions = points.shape
    k = len(centers)
    if centers.shape[1] != dimensions:
        raise ValueError(f"points have {dimensions} features but centers have {centers.shape[1]}")
    labels = np.zeros(rows, dtype=np.int64)
    own, other = np.empty(rows), np.empty(rows)
    center_norms = np.einsum("ij,ij->i", centers, centers)
    step = max(1, _BLOCK_BYTES // (8 * k))
    for start in range(0, rows, step):
        part = slice(start, start + step)
        block = points[part]
        # |x - c|^2 without |x|^2, which is the same for every centre of a row.
        ranks = centers @ block.T
        ranks *= -2.0
        ranks += center_norms[:, None]
        choice, best = labels[part], ranks[0].copy()
        runner_up, worse = np.full(len(block), np.inf), np.empty(len(block))
        for rank in ranks[1:]:
            np.maximum(best, rank, out=worse)
            np.minimum(runner_up, worse, out=runner_up)
            np.minimum(best, rank, out=best)
        for cluster in range(k - 1, -1, -1):
            np.copyto(choice, cluster, where=ranks[cluster] == best)
        norms = np.einsum("ij,ij->i", block, block)
        slack = 16.0 * (dimensions + 8) * np.finfo(float).eps * (norms.max() + center_norms.max())
        own[part] = np.sqrt(np.maximum(best + norms + slack, 0.0))
        other[part] = np.sqrt(np.maximum(runner_up + norms - slack, 0.0))
        unsure = ~(runner_up - best > slack)  # also true for NaN
        if k > 1 and unsure.any():
            choice[unsure] = _nearest_direct(block[unsure], centers)[0]
            other[part][unsure] = 0.0
    return labels, own, other


def _nearest_direct(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    labels = np.zeros(len(points), dtype=np.int64)
    best = _distances_to(points, centers[0])
    for cluster in range(1, len(centers)):
        distance = _distances_to(points, centers[cluster])
        closer = distance < best
        labels[closer] = cluster
        best[closer] = distance[closer]
    return labels, best


def sums_by(labels: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """(k, d) coordinate sums of the points of each label."""
    if k <= _ONE_HOT_LIMIT:
        return (labels == np.arange(k)[:, None]).astype(np.float64) @ points
    return np.stack([np.bincount(labels, weights=column, minlength=k) for column in points.T], axis=1)


@dataclass
class Statistics:
    """Additive cluster statistics: merge two by adding every field."""

    counts: np.ndarray
    sse: np.ndarray
    sums: np.ndarray

    @classmethod
    def empty(cls, k: int, dimensions: int) -> Statistics:
        return cls(np.zeros(k, dtype=np.int64), np.zeros(k), np.zeros((k, dimensions)))

    def add(self, points: np.ndarray, labels: np.ndarray, distances: np.ndarray) -> None:
        k = len(self.counts)
        self.counts += np.bincount(labels, minlength=k)
        self.sse += np.bincount(labels, weights=distances, minlength=k)
        self.sums += sums_by(labels, points, k)

    def means(self, previous: np.ndarray) -> np.ndarray:
        return means_of(self.counts, self.sums, previous)


def means_of(counts: np.ndarray, sums: np.ndarray, previous: np.ndarray) -> np.ndarray:
    """Cluster means; a cluster without members keeps its previous centre."""
    held = counts > 0
    centers = previous.copy()
    centers[held] = sums[held] / counts[held, None]
    return centers


def max_shift(old: np.ndarray, new: np.ndarray) -> float:
    """Largest squared movement of any centre."""
    if old.shape != new.shape or not len(old):
        raise ValueError("old and new centers must be non-empty and of equal shape")
    return float(_distances_to(old, new).max())


def race_seeds(points: np.ndarray, keys: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ rows of one group as exponential races, lowest ``-ln(u)/d2`` wins.

    The winner of such a race is row i with probability d2_i / sum(d2), the
    k-means++ law, and does not depend on row order.  When every row coincides with
    a chosen centre the smallest uniform among unchosen rows is taken.  Rows that share
    a key are one candidate: once it is chosen none of them is offered again.
    """
    chosen = [lowest(uniform_array(keys, seed, 0), keys)]
    free = keys != keys[chosen[0]]
    spread = _distances_to(points, points[chosen[0]])
    for draw in range(1, k):
        u = uniform_array(keys, seed, draw)
        if not free.any():
            raise ValueError(f"k={k} exceeds the number of different record ids")
        eligible = free & (spread > 0)
        if eligible.any():
            score = np.where(eligible, -np.log(u) / np.where(eligible, spread, 1.0), np.inf)
        else:
            score = np.where(free, u, np.inf)
        winner = lowest(score, keys)
        chosen.append(winner)
        free &= keys != keys[winner]
        np.minimum(spread, _distances_to(points, points[winner]), out=spread)
    return points[chosen]


def lowest(score: np.ndarray, keys: np.ndarray) -> int:
    """Row of the lowest score, the lowest key among equals."""
    tied = np.flatnonzero(score == score.min())
    return int(tied[keys[tied].argmin()])


@dataclass
class LocalFit:
    centers: np.ndarray
    counts: np.ndarray
    iterations: int
    converged: bool
    sse: float


def fit_group(
    points: np.ndarray, keys: np.ndarray, k: int, max_iterations: int, tolerance: float, seed: int
) -> LocalFit:
    """k-means of one bounded group: seeds, Lloyd until the centres rest, final pass."""
    if not np.isfinite(points).all():
        raise ValueError("features contain NaN or infinite values")
    order = np.argsort(keys, kind="stable")  # sums must not depend on arrival order
    points, keys = points[order], keys[order]
    return _settle(points, race_seeds(points, keys, k, seed), max_iterations, tolerance)


def _settle(points: np.ndarray, centers: np.ndarray, max_iterations: int, tolerance: float) -> LocalFit:
    """Lloyd rounds that measure a point again only when its label could have changed.

    After a round every centre is off by at most its own step, so a point whose own
    centre is surely nearer than any other keeps its label.  The labels, and hence
    the sums, are those of measuring every point in every round.
    """
    k = len(centers)
    labels = np.zeros(len(points), dtype=np.int64)
    own, other = np.full(len(points), np.inf), np.zeros(len(points))

    def relabel() -> None:
        open_ = np.flatnonzero(~(own * _SURE < other))
        if len(open_) == len(points):
            labels[:], own[:], other[:] = _two_nearest(points, centers)
        elif len(open_):
            labels[open_], own[open_], other[open_] = _two_nearest(points[open_], centers)

    iterations, converged = 0, False
    while iterations < max_iterations and not converged:
        relabel()
        moved = means_of(np.bincount(labels, minlength=k), sums_by(labels, points, k), centers)
        steps = np.sqrt(_distances_to(centers, moved))
        own += steps[labels]
        other -= steps.max()
        converged = max_shift(centers, moved) <= tolerance
        centers = moved
        iterations += 1
    relabel()
    error = float(_distances_to(points, centers[labels]).sum())
    return LocalFit(centers, np.bincount(labels, minlength=k), iterations, converged, error)
