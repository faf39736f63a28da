"""Shards against a plain version: sizes, slots, groups of equal texts."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from centroidal.llm.sharding import GROUPS_PER_SHARD, ROW_BYTES, _assigned, sharded


def table(spark, rows, partitions=5):
    schema = "doc_id bigint, text string, shard string, slot string, key int, size string, part int"
    return spark.createDataFrame([(*r, "s", "t", 1, "x", 2) for r in rows], schema).repartition(partitions)


def placed(spark, rows, shards, partitions=5):
    return [r.asDict() for r in sharded(table(spark, rows, partitions), shards).collect()]


def check(rows, found, shards):
    """The law, for any rows: nothing lost, gapless slots, near-equal bytes, groups whole where they fit."""
    size = [len((t or "").encode()) + ROW_BYTES for _, t in rows]
    wanted = Counter((i, s, zlib.crc32((t or "").encode())) for (i, t), s in zip(rows, size))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == wanted
    assert {(r["law"], r["grown_shard"]) for r in found} <= {("bytes", None)}
    slots, held = defaultdict(list), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())

    share = sum(size) / shards
    groups = Counter()
    for (_, t), s in zip(rows, size):
        groups[t or ""] += s
    # A group that stays whole reaches over a slice's edge by half of itself at most, a row that is spread too.
    margin = max(share / GROUPS_PER_SHARD, max(size)) + shards
    assert all(abs(held[k] - share) <= margin for k in range(shards)), (held, share)
    where = defaultdict(set)
    for r in found:
        where[r["text_crc32"]].add(r["shard"])
    for text, weight in groups.items():
        if weight <= share / GROUPS_PER_SHARD:
            assert len(where[zlib.crc32(text.encode())]) == 1
    return held, where


def words(rng, most):
    return " ".join(rng.choices("lorem ipsum dolor sit amet 漢字 é".split(), k=rng.randrange(1, most)))


def test_ordinary_rows(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 60)) for i in range(2000)]
    rows += [(3000 + i, rows[i % 40][1]) for i in range(300)]
    rows += [(1, None), (2, ""), (None, "no id"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (5, "other")]
    check(rows, placed(spark, rows, 40), 40)
    check(rows, placed(spark, rows, 1), 1)
    check(rows, placed(spark, rows, 7), 7)


def test_large_groups_stay_whole(spark):
    """Groups of a fifth to all of a shard are given shards of their own, and sizes stay equal."""
    rng = random.Random(4)
    rows = [(i, words(rng, 40)) for i in range(3000)]
    for g in range(12):
        rows += [(10_000 + 1000 * g + i, f"group {g} " * 5) for i in range(100 + 15 * g)]
    held, where = check(rows, placed(spark, rows, 20), 20)
    assert all(len(where[zlib.crc32((f"group {g} " * 5).encode())]) == 1 for g in range(12))


def test_one_text_with_most_rows(spark):
    """A text that no shard can hold is spread, by its rows."""
    rng = random.Random(5)
    rows = [(i, "the same text") for i in range(3000)] + [(9000 + i, words(rng, 30)) for i in range(500)]
    rows += [(7, "the same text")] * 500 + [(None, "the same text")] * 100
    held, where = check(rows, placed(spark, rows, 16), 16)
    assert len(where[zlib.crc32(b"the same text")]) > 5


@pytest.mark.parametrize("text", ["", "x"])
def test_only_equal_rows(spark, text):
    rows = [(1, text)] * 64
    check(rows, placed(spark, rows, 8), 8)


def test_a_very_long_text(spark):
    rows = [(0, "word " * 400_000)] + [(i, f"short {i}") for i in range(1, 400)]
    found = placed(spark, rows, 4)
    assert sorted(r["doc_id"] for r in found) == list(range(400))
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fewer_rows_than_shards_and_empty_table(spark):
    found = placed(spark, [(1, "a"), (2, "b"), (3, None)], 40)
    assert len(found) == 3 and all(0 <= r["shard"] < 40 and r["slot"] == 0 for r in found)
    assert sharded(table(spark, [(1, "a")]).limit(0)).collect() == []
    with pytest.raises(ValueError):
        sharded(table(spark, [(1, "a")]), 0)


def test_layout_does_not_matter(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 30)) for i in range(600)]
    rows += [(1000 + i, rows[i % 20][1]) for i in range(100)]

    def key(r):
        return (r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])

    first = sorted(map(key, placed(spark, rows, 10)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sorted(map(key, placed(spark, rows[::-1], 10, partitions=2))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_python_in_the_plan(spark):
    plan = sharded(table(spark, [(i, f"t{i}") for i in range(50)]), 4)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_assignment_of_large_groups():
    taken, room = _assigned([(1, 9), (2, 5), (3, 5), (4, 4)], [10, 10])
    assert taken == {1: 0, 2: 1, 3: 1} and room == [1, 0]
    assert _assigned([(1, 11)], [10, 10]) == ({}, [10, 10])
