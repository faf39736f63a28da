"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by a key: a hash of the text, so that equal texts lie together, then a
hash of the id.  A size-weighted sample of keys gives quantile boundaries; they cut the
key range into many small ranges, so that no task sorts more than one of them.  A range
that holds too much after the exact count is subdivided: texts that are heavy by
themselves (say, one with a third of all rows) by the hash of the id, the rest by the key.
The exact bytes before each part, plus a running sum inside it, place every row in the
total order, and slices of the bytes are the shards.  Equal texts are cut at no slice: a
text is placed by its middle, and those that would make slices uneven are given a shard
first, whose slice is shorter then.  Nothing but boundaries and large groups (a bounded
number) passes through the driver.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from heapq import heapify, heapreplace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from centroidal.llm.common import documents, ids_and_texts, written

SHARDS = 40
ROW_BYTES = 16  # what a row weighs besides its text
RANGES_PER_SHARD = 16  # at least
MOST_RANGES = 8192
RANGE_BYTES = 1 << 30  # wanted in a range of a large table
SAMPLES_PER_RANGE = 20
GROUPS_PER_SHARD = 10  # equal texts of more than this part of a shard are placed before all others
CELLS = 1024  # of the key range, to find a key's boundaries without comparing them all
KEY_BITS = 48


def _keyed(docs: DataFrame) -> DataFrame:
    """One narrow row per document; a null text has no bytes, and null ids are one id."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return ids_and_texts(docs).select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key"),
        F.shiftrightunsigned(F.xxhash64(F.lit("tie"), "doc_id"), 64 - KEY_BITS).alias("tie"),
    )


def splitters(keyed: DataFrame, ranges: int, total: int) -> list[int]:
    """Quantiles of a size-weighted sample of about ``ranges * SAMPLES_PER_RANGE`` keys.

    A row is drawn with probability size / step; a row larger than a step counts as often
    as it holds steps.  The draw is a hash of the row, so a task that runs again draws the
    same.  The sample's size does not depend on the table's.
    """
    step = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    draw = F.pmod(F.xxhash64(F.lit("draw"), "key", "tie", "size"), F.lit(1 << 20)) / float(1 << 20)
    drawn = keyed.select("key", F.floor(F.col("size") / step + draw).alias("times")).filter("times > 0")
    at = [i / ranges for i in range(1, ranges)]
    found = drawn.agg(F.percentile("key", at, F.col("times")).alias("at")).first()["at"]
    return sorted({math.floor(x) for x in found or []})


def _range_of(keyed: DataFrame, bounds: list[int]) -> DataFrame:
    """Add ``range``: the number of boundaries at or below the key.

    The boundaries inside each of CELLS equal parts of the key range are a table of CELLS
    rows, so a row is compared with a few boundaries only.
    """
    shift = KEY_BITS - CELLS.bit_length() + 1
    first = [bisect_right(bounds, (cell << shift) - 1) for cell in range(CELLS + 1)]
    rows = [(cell, first[cell], bounds[first[cell] : first[cell + 1]]) for cell in range(CELLS)]
    cells = keyed.sparkSession.createDataFrame(rows, "cell bigint, below int, inside array<bigint>")
    passed = F.size(F.filter("inside", lambda bound: bound <= F.col("key")))
    return (
        keyed.withColumn("cell", F.shiftright("key", shift))
        .join(F.broadcast(cells), "cell")
        .withColumn("range", F.col("below") + passed)
        .drop("cell", "below", "inside")
    )


def _celled(ranged: DataFrame, most: float) -> DataFrame:
    """Add ``heavy`` and ``part``: what no task holds too much of.

    Equal texts that weigh over half of ``most`` are ``heavy``; each such text is cut into parts
    by the hash of the id.  What else lies in an overfull range is cut by another hash of the
    key, so that equal texts stay in one part.  ``heavy`` is the key, or -1.
    """
    held = ranged.groupBy("range", "key").agg(F.sum("size").alias("held"))
    held = written(held.select("range", F.when(F.col("held") > most / 2, F.col("key")).otherwise(-1).alias("heavy"), "held"), "shard-keys")
    # At most one row for each range, and two for each ``most`` bytes of the table.
    cells = held.groupBy("range", "heavy").agg(F.ceil(F.sum("held") / most).alias("parts"))
    heavy = cells.filter("heavy >= 0").select(F.col("range").alias("its_range"), F.col("heavy").alias("its_key"), F.col("parts").alias("own_parts"))
    light = cells.filter("heavy < 0").select("range", F.col("parts").alias("light_parts"))
    same = (F.col("range") == F.col("its_range")) & (F.col("key") == F.col("its_key"))
    joined = ranged.join(F.broadcast(heavy), same, "left").join(F.broadcast(light), "range", "left")
    by_id = F.floor(F.col("tie") / float(1 << KEY_BITS) * F.col("own_parts"))
    by_key = F.pmod(F.xxhash64(F.lit("part"), "key"), F.coalesce("light_parts", F.lit(1)))
    return joined.select(
        *ranged.columns, F.coalesce("its_key", F.lit(-1)).alias("heavy"), F.coalesce(by_id, by_key).cast("bigint").alias("part")
    )


def _assigned(groups: list[tuple[int, int]], targets: list[int]) -> tuple[dict[int, int], list[int]]:
    """Shards of large groups (key, bytes), the largest first into the emptiest, and what is left of the targets.

    A group that fits nowhere is left out; its rows are placed one by one.
    """
    room = [(-target, shard) for shard, target in enumerate(targets)]
    heapify(room)
    taken = {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        left, shard = room[0]
        if size <= -left:
            taken[key] = shard
            heapreplace(room, (left + size, shard))
    return taken, [-left for left, _ in sorted(room, key=lambda r: r[1])]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per row of ``docs``.

    The law is ``bytes``: every shard holds total / shards bytes, but for a tenth of that or a
    row at each end.  Equal texts share a shard as long as all of them fit into one; beyond
    that they are spread.  ``slot`` counts a shard's rows from 0 in the order of key, tie, id and size; rows
    alike in all of these are interchangeable.  A null text weighs ROW_BYTES and is equal to the
    empty one, null ids and repeated ids are ids like others, columns other than id and text
    are not read.  Fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    if shards <= 0:
        raise ValueError("the number of shards must be positive")
    keyed = written(_keyed(docs), "shard-keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, math.ceil(total / RANGE_BYTES)))
    ranged = _range_of(keyed, splitters(keyed, ranges, total))
    cut = _celled(ranged, max(1.0, 2 * total / ranges))

    cell = ["range", "heavy", "part"]
    inside = Window.partitionBy(*cell).orderBy("key", "tie", "doc_id", "size", "text_crc32")
    alike = Window.partitionBy(*cell, "key")  # the rows of a text lie together in their cell
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = cut.withColumn("row", F.row_number().over(inside) - 1).withColumn("bytes_before", before)
    placed = written(
        placed.withColumn("group_before", F.min("bytes_before").over(alike)).withColumn("group_bytes", F.sum("size").over(alike)),
        "shard-places",
    )
    cells = written(placed.groupBy(*cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-cells")

    # Large groups: at most one for each tenth of a shard.
    targets = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    share = max(1, total // shards)
    heavy = cells.filter("heavy >= 0").groupBy("heavy").agg(F.sum("bytes").alias("bytes"))
    large = [(r["heavy"], r["bytes"]) for r in heavy.filter(F.col("bytes") > share // GROUPS_PER_SHARD).collect()]
    taken, room = _assigned(large, targets)
    spread = sorted({key for key, _ in large} - taken.keys())
    spark = docs.sparkSession
    own = spark.createDataFrame(sorted(taken.items()), "heavy bigint, own_shard int")
    loose = spark.createDataFrame([(key, True) for key in spread], "heavy bigint, loose boolean")
    cells = cells.join(F.broadcast(own), "heavy", "left").join(F.broadcast(loose), "heavy", "left")

    # A bounded number of ranges, heavy texts and parts.
    order = Window.partitionBy(F.col("own_shard").isNull()).orderBy(F.coalesce("own_shard", F.lit(-1)), *cell)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumns(
        {"bytes_offset": F.coalesce(F.sum("bytes").over(upto), F.lit(0)), "rows_offset": F.coalesce(F.sum("rows").over(upto), F.lit(0))}
    )
    whole = Window.partitionBy("own_shard", "heavy")
    offsets = offsets.withColumns({"heavy_offset": F.min("bytes_offset").over(whole), "heavy_bytes": F.sum("bytes").over(whole)})
    # Twice the middle of what is placed together: a row, a text inside a cell, or a heavy text.
    middle = (
        F.when(F.col("loose"), 2 * (F.col("bytes_offset") + F.col("bytes_before")) + F.col("size"))
        .when(F.col("heavy") >= 0, 2 * F.col("heavy_offset") + F.col("heavy_bytes"))
        .otherwise(2 * (F.col("bytes_offset") + F.col("group_before")) + F.col("group_bytes"))
    )
    ends = F.array(*[F.lit(2 * end).cast("bigint") for end in itertools.accumulate(room)][:-1]).cast("array<bigint>")
    filled = F.size(F.filter(ends, lambda end: end <= middle))
    named = offsets.drop("bytes", "rows").toDF(*[f"cell_{c}" for c in offsets.drop("bytes", "rows").columns])
    same = (F.col("range") == F.col("cell_range")) & (F.col("heavy") == F.col("cell_heavy")) & (F.col("part") == F.col("cell_part"))
    joined = placed.join(F.broadcast(named), same)
    for c in ("own_shard", "loose", "bytes_offset", "rows_offset", "heavy_offset", "heavy_bytes"):
        joined = joined.withColumnRenamed(f"cell_{c}", c)
    ordered = joined.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("own_shard").isNull().alias("fills"),
        F.coalesce("own_shard", filled).alias("shard"),
        (F.col("rows_offset") + F.col("row")).alias("place"),
    )
    # What a shard was given comes first, then what fills it up: two rows for each shard.
    firsts = ordered.groupBy("shard", "fills").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    given = F.sum("n").over(Window.partitionBy("shard").orderBy("fills").rowsBetween(Window.unboundedPreceding, -1))
    firsts = firsts.withColumn("given", F.coalesce(given, F.lit(0))).drop("n")
    return ordered.join(F.broadcast(firsts), ["shard", "fills"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("given") + F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_shards(spark, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
