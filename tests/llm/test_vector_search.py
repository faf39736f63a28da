"""Top-k search against brute force and SQL."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from centroidal.llm import vector_search as search
from tests.compare import connect, differences


def plain(vectors, queries, k):
    out = []
    for q, a in {q: a for q, a in queries}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in vectors if v != q and len(a) == len(b))
        out += [(q, r, v, -s) for r, (s, v) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size,spread", [(1, 2), (3, 4), (8, 300), (5, 10**7)])
def test_against_brute_force(spark, monkeypatch, size, spread):
    monkeypatch.setattr(search, "BLOCK_ROWS", 37)
    monkeypatch.setattr(search, "QUERY_ROWS", 9)
    monkeypatch.setattr(search, "READ_STEP", 3)
    rng = random.Random(size)
    rows = [(i, [rng.randrange(-spread, spread) for _ in range(size)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>").repartition(3)
    asked = [r for r in rows if r[0] % 10 == 0]
    found = search.exact_top_k(df, df.filter("vec_id % 10 = 0"), k=4)
    assert sorted(map(tuple, found.collect())) == plain(rows, asked, 4)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (None, [1.0, 1.0]), (100, [1.0, 1.0, 1.0]), (150, []), (5, [0.1, 0.2]), (5, [0.1, 0.2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string")
    vectors = search.scaled(df)
    usable = [(r.vec_id, r.vector) for r in vectors.collect()]
    assert sorted(i for i, _ in usable) == [0, 5, 5, 50, 100, 150]
    found = search.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
    assert sorted(map(tuple, found.collect())) == plain(usable, [u for u in usable if u[0] % 50 == 0], 5)
    assert search.exact_top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(search.op3_exact_top_k(spark, sf_dir), connect(sf_dir), search.OP3_SQL) == []


def test_queries_are_not_broadcast(spark, monkeypatch):
    """Copies of the queries for all slices weigh 30 MB here; broadcast, they went through the driver."""
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-99, 99) for _ in range(64)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>").repartition(3)
    settings = {"spark.sql.shuffle.partitions": "200", "spark.sql.maxBroadcastTableSize": "16m", "spark.sql.autoBroadcastJoinThreshold": "10m"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = sorted(map(tuple, search.exact_top_k(df, df.filter("vec_id % 2 = 0"), k=2).collect()))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == plain(rows, [r for r in rows if r[0] % 2 == 0], 2)


def test_slices_meet_groups(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(search, "QUERY_ROWS", 8)
    monkeypatch.setattr(search, "SLICE_BYTES", 2000)
    monkeypatch.setattr(search, "GROUP_BYTES", 300)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-50, 50) for _ in range(2 + i % 2)]) for i in range(400)] + [(7, [1, 2]), (8, [3, 4]), (8, [3, 4])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>").repartition(2)
    asked = [r for r in rows if r[0] % 9 == 0]
    found = search.exact_top_k(df, df.filter("vec_id % 9 = 0"), k=3)
    assert sorted(map(tuple, found.collect())) == plain(rows, asked, 3)


def test_grid():
    """Copies of both sides stay in proportion to them, whatever the number of shuffle partitions is."""
    of = lambda rows, blocks, **more: {"rows": rows, "blocks": blocks, "bytes": rows * 200, "most": 1, **more}
    row = lambda **x: search.Row(**x)
    assert search._grid(row(**of(0, 0)), row(**of(0, 0)), 6) == (1, 1)
    assert search._grid(row(**of(615_384, 151)), row(**of(12_308, 13)), 6) == (24, 1)
    slices, groups = search._grid(row(**of(15_400_000, 3760)), row(**of(308_000, 301)), 6)
    assert slices * 308_000 + groups * 15_400_000 < 5 * 15_400_000


@pytest.mark.parametrize("spread", [1, 3, 200, 10**6, 10**8])
def test_blocks_against_brute_force(monkeypatch, spread):
    monkeypatch.setattr(search, "HITS", 50)
    rng, k = np.random.default_rng(spread), 4
    blocks, ids, exact = [], [], []
    for rows in (2, 300, 1, 150):
        own, numbers = rng.integers(0, 200, rows), rng.integers(-spread, spread, (rows, 6))
        low, width = search._edges(numbers)
        row = {"size": 6, "ids": own.tobytes(), "cells": ((numbers - low) // width).astype(np.uint8).tobytes(), "edges": np.stack([low, width]).tobytes()}
        kept = search._narrow(numbers)
        blocks.append(search._Block(row | {"exact": kept.tobytes(), "width": kept.itemsize}))
        ids, exact = [*ids, *own.tolist()], [*exact, *numbers.tolist()]
    queries = rng.integers(-spread, spread, (40, 6))
    lows = search._greatest_lows(blocks, np.arange(40), queries, k)
    query, found, scores = search._best_exact(blocks, np.arange(40), queries, lows[:, -1], k, 3)
    wanted = plain(list(zip(ids, exact)), list(enumerate(queries.tolist())), k)
    assert sorted(zip(query.tolist(), found.tolist(), scores.tolist())) == sorted((q, v, s) for q, _, v, s in wanted)
    assert (lows[:, ::-1] <= np.sort(scores.reshape(40, k), axis=1)).all()
