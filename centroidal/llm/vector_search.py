"""Exact top-k search with vector-approximation files.

Vectors are packed into blocks: their cells (each component quantised to one byte between
the block's least and greatest value of that component), and their exact components apart.
A query first scans a block's cells only.  The edges of a cell bound a component from below
and above, and all cells of a component are equally wide in a block, so one matrix product
bounds the scores of all pairs.  Exact vectors are then read in the order of their upper
bounds until the k-th best exact score is above every bound left.

A first pass finds, for each query, the k-th greatest lower bound over all blocks; the second
reads only vectors whose upper bound reaches it.  Blocks of vectors are dealt into slices and
blocks of queries into groups; each slice meets each group once, by a shuffle.  A slice is
copied to every group and a group to every slice, never a block to every block, and how many
there are follows from the sizes of both sides, so that no side has to fit in memory, in the
driver's neither: nothing is broadcast or collected but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from centroidal.llm.common import table, written

K = 5
SCALE = 256
QUERY_STEP = 50
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
BLOCK_NUMBERS = 1 << 20  # components in a block, also of long vectors
READ_STEP = 64  # exact vectors of a query read at once
SLICE_BYTES = GROUP_BYTES = 32 << 20  # of vectors, of queries, that meet in a task
TASK_PAIRS = 1 << 35  # of a query and a vector, in a task
HITS = 1 << 18  # pairs of a block looked at one by one, at once


def scaled(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vector array<bigint>)``: floor(256 x); rows that cannot be scored are left out.

    Those are rows without id, null vectors and vectors with a null or non-finite component.
    """
    given = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("given"))
    finite = F.forall("given", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = given.filter(F.col("vec_id").isNotNull() & F.col("given").isNotNull() & finite)
    return usable.select("vec_id", F.transform("given", lambda x: F.floor(SCALE * x)).alias("vector"))


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of vectors of the same length: ids, exact components, cells and their edges.

    ``part`` and ``number`` count the tasks and a task's blocks; ``width`` is the number of
    bytes of an exact component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        part, made = TaskContext.get().partitionId(), 0

        def block(size: int) -> pa.RecordBatch:
            nonlocal made
            parts = held.pop(size)
            ids, exact = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            low, width = _edges(exact)
            cells = ((exact - low) // width).astype(np.uint8)
            exact = _narrow(exact)
            whole = [part, made, size, len(ids), exact.itemsize]
            made += 1
            bits = [ids.tobytes(), exact.tobytes(), cells.tobytes(), np.stack([low, width]).tobytes()]
            columns = [pa.array([v], pa.int32()) for v in whole] + [pa.array([v], pa.binary()) for v in bits]
            return pa.RecordBatch.from_arrays(columns, ["part", "number", "size", "rows", "width", "ids", "exact", "cells", "edges"])

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                most = max(1, min(rows, BLOCK_NUMBERS // max(1, size)))
                for start in range(0, len(own), most):
                    some = own[start : start + most]
                    exact = flat[starts[some][:, None] + np.arange(size)].reshape(len(some), size)
                    held.setdefault(size, []).append((ids[some], exact))
                    if sum(len(p[0]) for p in held[size]) >= most:
                        yield block(size)
        for size in list(held):
            yield block(size)

    return vectors.mapInArrow(
        run, "part int, number int, size int, rows int, width int, ids binary, exact binary, cells binary, edges binary"
    )


def _edges(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower edge of cell 0 and width of a cell, by component."""
    low = exact.min(axis=0) if len(exact) else np.zeros(exact.shape[1], np.int64)
    high = exact.max(axis=0) if len(exact) else low
    return low, np.maximum(1, -(-(high - low + 1) // 256))


def _narrow(exact: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them all."""
    low, high = exact.min(initial=0), exact.max(initial=0)
    return exact.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _below(numbers: np.ndarray, kind: type) -> np.ndarray:
    """The numbers as ``kind``, never rounded up."""
    with np.errstate(over="ignore"):
        out = numbers.astype(kind)
    return np.where(out > numbers, np.nextafter(out, kind(-np.inf)), out)


class _Block:
    """One block of the vector-approximation file."""

    def __init__(self, row: dict):
        size = row["size"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.cells = np.frombuffer(row["cells"], np.uint8).reshape(len(self.ids), size)
        self.low, self.width = np.frombuffer(row["edges"], np.int64).reshape(2, size).astype(np.float64)
        if "exact" in row:
            self.exact = np.frombuffer(row["exact"], f"i{row['width']}").reshape(len(self.ids), size)
        self.by_id = np.argsort(self.ids, kind="stable")

    def bounds(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scan, least, most): query q and vector v score from scan[q, v] + least[q] to scan[q, v] + most[q].

        Whole numbers in floats that hold them exactly, or else bounds with some slack.  The scan
        is -inf where a vector has the query's own id.
        """
        query = queries.astype(np.float64)
        weights, base, spare = query * self.width, query @ self.low, self.width - 1
        reach = np.abs(query) @ (np.abs(self.low) + 256 * self.width)
        slack = np.where(reach < 2.0**52, 0.0, 1e-9 * reach + 1)
        kind = np.float32 if 256 * np.abs(weights).sum(axis=1).max(initial=0) < 2.0**24 else np.float64
        scan = weights.astype(kind) @ self.cells.astype(kind).T
        ordered = self.ids[self.by_id]
        first, end = (np.searchsorted(ordered, query_ids, side) for side in ("left", "right"))
        for q in np.flatnonzero(end > first).tolist():
            scan[q, self.by_id[first[q] : end[q]]] = -np.inf
        return scan, base + np.minimum(query, 0) @ spare - slack, base + np.maximum(query, 0) @ spare + slack


def _hits(reached: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns where a matrix is true, for as many rows at once as hold about ``HITS``."""
    cuts = [0, len(reached)]
    if np.count_nonzero(reached) > HITS:
        cuts[1:1] = (np.flatnonzero(np.diff(np.cumsum(np.count_nonzero(reached, axis=1)) // HITS)) + 1).tolist()
    for start, end in zip(cuts, cuts[1:]):
        rows, columns = np.divmod(np.flatnonzero(reached[start:end]), max(1, reached.shape[1]))
        if len(rows):
            yield rows + start, columns


def _kth_at_least(scan: np.ndarray, k: int) -> np.ndarray:
    """A number that k of each row reach: the k-th greatest of the maxima of some runs of columns."""
    rows, columns = scan.shape
    step = max(1, columns // max(64, 4 * k))
    runs = columns // step
    if runs < k:
        return np.full(rows, -np.inf, scan.dtype)
    return np.partition(scan[:, : runs * step].reshape(rows, runs, step).max(axis=2), runs - k, axis=1)[:, runs - k]


def _greatest_lows(blocks: list[_Block], query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The k greatest lower bounds of each query over the blocks, in falling order; -inf where there are fewer."""
    best = np.full((len(query_ids), k), -np.inf)
    every = np.repeat(np.arange(len(query_ids)), k)
    for block in blocks:
        scan, least, _ = block.bounds(query_ids, queries)
        floor = _below(best[:, -1] - least, scan.dtype.type)
        if np.isneginf(floor).any():
            # Of the k best of this block, those not above ``kth`` are equal to it.
            kth = _kth_at_least(scan, k)
            more = np.where((kth > floor)[:, None], (kth + least)[:, None], -np.inf)
            best = -np.sort(-np.concatenate([best, np.repeat(more, k, axis=1)], axis=1), axis=1)[:, :k]
            floor = np.maximum(floor, kth)
        for rows, columns in _hits(scan > floor[:, None]):
            query, low = np.concatenate([every, rows]), np.concatenate([best.ravel(), scan[rows, columns] + least[rows]])
            order = np.lexsort((-low, query))
            starts = np.searchsorted(query[order], np.arange(len(query_ids)))
            best = low[order][starts[:, None] + np.arange(k)]
    return best


def _best_exact(
    blocks: list[_Block], query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, step: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, vector, score) of the best k of the blocks, of scores that reach the query's floor."""
    query, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    last_score, last_id = floor.copy(), np.full(len(query_ids), np.iinfo(np.int64).max)
    for block in blocks:
        scan, _, most = block.bounds(query_ids, queries)
        # At least a finite number, so that no vector with the query's own id is met.
        reach = np.maximum(_below(last_score - most, scan.dtype.type), np.finfo(scan.dtype).min)
        for rows, columns in _hits(scan >= reach[:, None]):
            order = np.lexsort((block.ids[columns], -scan[rows, columns], rows))
            rows, columns = rows[order], columns[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            upper, found = scan[rows, columns] + most[rows], block.ids[columns]
            left = np.arange(len(rows))
            for end in range(step, int(place.max()) + step + 1, step):
                # What is left of a query ranks no higher than its next.
                left = left[(upper[left] > last_score[rows[left]]) | ((upper[left] == last_score[rows[left]]) & (found[left] <= last_id[rows[left]]))]
                now, left = left[place[left] < end], left[place[left] >= end]
                if not len(now):
                    break
                score = _scores(queries, rows[now], block.exact, columns[now])
                now, score = now[score >= floor[rows[now]]], score[score >= floor[rows[now]]]
                query, ids, scores = (np.concatenate(x) for x in ((query, rows[now]), (ids, found[now]), (scores, score)))
                order = np.lexsort((ids, ~scores, query))  # ~ turns the order round and never overflows
                order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
                query, ids, scores = query[order], ids[order], scores[order]
                ends = np.flatnonzero(np.bincount(query, minlength=len(query_ids)) == k)
                last = np.searchsorted(query, ends, "right") - 1
                last_score[ends], last_id[ends] = scores[last], ids[last]
    return query, ids, scores


def _scores(queries: np.ndarray, rows: np.ndarray, vectors: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact scores of pairs, for a bounded number of components at once."""
    out = np.zeros(len(rows), np.int64)
    most = max(1, BLOCK_NUMBERS // max(1, vectors.shape[1]))
    for start in range(0, len(rows), most):
        part = slice(start, start + most)
        out[part] = (queries[rows[part]] * vectors[columns[part]].astype(np.int64)).sum(axis=1)
    return out


def _query_blocks(queries: pa.Table) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for row in range(queries.num_rows):
        block = {name: queries.column(name)[row].as_py() for name in queries.column_names}
        ids = np.frombuffer(block["query_ids"], np.int64)
        yield block, ids, np.frombuffer(block["queries"], f"i{block['width']}").reshape(len(ids), block["size"]).astype(np.int64)


LOWS = {"size": pa.int32(), "query_block": pa.int64(), "low": pa.binary()}
FOUND = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}


def _lower_bounds(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The k greatest lower bounds of each query in a slice."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        blocks, out = [_Block(row) for row in vectors.to_pylist()], []
        for block, ids, numbers in _query_blocks(queries) if blocks else ():
            low = _greatest_lows(blocks, ids, numbers, k)
            out.append({"size": block["size"], "query_block": block["query_block"], "low": low.tobytes()})
        return pa.Table.from_pylist(out, pa.schema(LOWS))

    return run


def _floors(k: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The k-th greatest lower bound of each query, over the bounds of all slices."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        merged = None
        for low in rows.column("low"):
            own = np.frombuffer(low.as_py(), np.float64).reshape(-1, k)
            both = own if merged is None else np.concatenate([merged, own], axis=1)
            merged = -np.partition(-both, k - 1, axis=1)[:, :k]
        return pa.table({"size": rows.column("size")[:1], "query_block": rows.column("query_block")[:1], "floor": [merged.min(axis=1).tobytes()]})

    return run


def _refined(k: int, step: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The best k of each query in a slice, by exact score."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        blocks, out = [_Block(row) for row in vectors.to_pylist()], [pa.table({name: pa.array([], kind) for name, kind in FOUND.items()})]
        for block, ids, numbers in _query_blocks(queries) if blocks else ():
            query, found, scores = _best_exact(blocks, ids, numbers, np.frombuffer(block["floor"], np.float64), k, step)
            out.append(pa.table({"query_id": ids[query], "vec_id": found, "score": scores}))
        return pa.concat_tables(out)

    return run


def _measured(blocks: DataFrame) -> Row:
    """Numbers of blocks, of rows and of bytes, and most blocks of a task."""
    size = F.col("rows").cast("bigint") * (8 + F.col("size") * (1 + F.col("width")))
    totals = [F.count("*").alias("blocks"), F.sum("rows").alias("rows"), F.sum(size).alias("bytes"), (F.max("number") + 1).alias("most")]
    return blocks.agg(*(F.coalesce(t, F.lit(0)).alias(n) for t, n in zip(totals, ("blocks", "rows", "bytes", "most")))).first()


def _grid(vectors: Row, queries: Row, cores: int) -> tuple[int, int]:
    """How many slices of vectors meet how many groups of queries.

    Slices are copied by groups and groups by slices: for a number of tasks the least is
    copied where both sides of a task weigh about the same.
    """
    tasks = max(4 * cores, -(-vectors.rows * queries.rows // TASK_PAIRS))
    groups = max(1, -(-queries.bytes // GROUP_BYTES), round((tasks * queries.bytes / max(1, vectors.bytes)) ** 0.5))
    groups = max(1, min(queries.blocks, groups))
    return max(1, min(vectors.blocks, max(-(-tasks // groups), -(-vectors.bytes // SLICE_BYTES)))), groups


def _dealt(most: int, n: int) -> Column:
    """One of ``n`` numbers for a block, each for about as many blocks."""
    return F.pmod(F.col("part").cast("bigint") * F.lit(most) + F.col("number"), F.lit(n)).cast("int")


def _copied(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k vectors of greatest inner product for each query.

    Both tables are ``(vec_id bigint, vector array<bigint>)``.  A vector with the query's own id
    is no candidate; ties go to the smaller id; fewer candidates give fewer rows.  Only vectors
    of the same length are compared.  Of repeated ids each row is a candidate of its own, and
    repeated queries are asked once.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    packed = written(_packed(vectors, BLOCK_ROWS), "vector-approximations")
    asked = written(_packed(queries.dropDuplicates(["vec_id"]).coalesce(cores), QUERY_ROWS), "query-blocks")
    of_vectors, of_queries = _measured(packed), _measured(asked)
    slices, groups = _grid(of_vectors, of_queries, cores)

    on = ["size", "query_group", "slice"]
    pairs = _copied(packed.withColumn("slice", _dealt(of_vectors["most"], slices)), "query_group", groups)
    number = F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("number")
    asked = asked.select(
        "size", "width", number.alias("query_block"), _dealt(of_queries["most"], groups).alias("query_group"), F.col("ids").alias("query_ids"), F.col("exact").alias("queries")
    )

    cells = pairs.select(*on, "ids", "cells", "edges").groupBy(*on)
    low = cells.cogroup(_copied(asked, "slice", slices).groupBy(*on)).applyInArrow(_lower_bounds(k), "size int, query_block bigint, low binary")
    floors = low.groupBy("size", "query_block").applyInArrow(_floors(k), "size int, query_block bigint, floor binary")
    floors = written(floors, "query-floors")
    asked = asked.join(floors.hint("merge"), ["size", "query_block"])
    blocks = pairs.select(*on, "width", "ids", "exact", "cells", "edges").groupBy(*on)
    best = blocks.cogroup(_copied(asked, "slice", slices).groupBy(*on)).applyInArrow(
        _refined(k, READ_STEP), "query_id bigint, vec_id bigint, score bigint"
    )
    # At most k rows for each query and slice.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))


OP3_SQL = f"""
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.vector, v.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM usable q JOIN usable v ON q.vec_id <> v.vec_id
    WHERE q.vec_id % {QUERY_STEP} = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
