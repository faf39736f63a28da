"""Blocks of documents that ask questions of shards of a global index.

An operator that must know something global about every n-gram or span of every text would
shuffle far more than the texts if each were a row.  Instead documents are dealt out into
blocks by a hash.  A block lists its distinct keys once, as one packed row for each shard of
the key space (a *letter*); a shard reads all letters for it and answers in the order of
their keys; and the block, dealt out again in the same way, reads the answers.  A key that
occurs everywhere is in one letter of each block, so no shard holds more of it than there
are blocks, and a hot document group is spread over blocks by its ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from centroidal.llm.common import quoted

BLOCK_BYTES = 4_000_000  # of text in a block, on average
LETTERS = "block int, shard int, letter binary"


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(docs: DataFrame, total: int) -> DataFrame:
    """Add ``block`` and deal out by it: equal ids and texts share a block, and nothing else decides."""
    n = partitions_of(docs)
    blocks = max(4 * n, -(-total // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.lit("block"), "doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int")
    return docs.withColumn("block", block).repartition(max(n, blocks // 8), "block")


def with_carried(docs: DataFrame, others: list[str]) -> DataFrame:
    """``(doc_id, text, carried)`` with the other columns in a struct."""
    held = [F.col(quoted(c)) for c in others] or [F.lit(True).alias("none")]
    doc_id, text = F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    return docs.select(doc_id, text, F.struct(*held).alias("carried"))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows with the same key, of a partition sorted by it."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if current is not None and keys[start] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = int(keys[start])
            held.append(batch.slice(start, end - start))
    if current is not None:
        yield current, pa.Table.from_batches(held)


def block_rows(rows: pa.Table) -> tuple[list[int], list[int | None], list[str | None]]:
    """Places, ids and texts of a block's rows in an order that any task finds again; null ids come last."""
    ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] is not None, texts[i] or ""))
    return order, [ids[i] for i in order], [texts[i] for i in order]


def letters_of(dealt_docs: DataFrame, write: Callable[[int, pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """One letter for each shard that a block has keys of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groups(batches, "block"):
            written = list(write(block, rows))
            if written:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(written), pa.int32()),
                        pa.array([s for s, _ in written], pa.int32()),
                        pa.array([x for _, x in written], pa.binary()),
                    ],
                    ["block", "shard", "letter"],
                )

    return dealt_docs.sortWithinPartitions("block").mapInArrow(run, LETTERS)


def answered(letters: DataFrame, answer: Callable[[list[int], list[bytes]], list[bytes]], tasks: int) -> DataFrame:
    """The answers of each shard to the letters it gets, one for each letter; empty ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groups(batches, "shard"):
            blocks = rows.column("block").to_pylist()
            order = sorted(range(len(blocks)), key=blocks.__getitem__)
            blocks = [blocks[i] for i in order]
            column = rows.column("letter")
            replies = answer(blocks, [column[i].as_py() for i in order])
            kept = [(b, r) for b, r in zip(blocks, replies) if r]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in kept], pa.int32()),
                    pa.array([shard] * len(kept), pa.int32()),
                    pa.array([r for _, r in kept], pa.binary()),
                ],
                ["block", "shard", "letter"],
            )

    return letters.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, LETTERS)


def read_back(
    dealt_docs: DataFrame, replies: DataFrame, read: Callable[[int, pa.Table, dict[int, bytes]], pa.Table], schema: StructType | str
) -> DataFrame:
    """Give each block its rows and the answers to its letters, by shard."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = (rows if rows.num_rows else answers).column("block")[0].as_py()
        by_shard = dict(zip(answers.column("shard").to_pylist(), answers.column("letter").to_pylist()))
        return read(block, rows, by_shard)

    return dealt_docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)
