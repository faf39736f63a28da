"""Elias-Fano sequences, tries and scores against plain computations."""

import bisect
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from centroidal.llm import language_model as lm
from centroidal.llm.elias_fano import EliasFano, Level, Trie


@pytest.mark.parametrize("n,most", [(0, 0), (1, 0), (1, 2**64 - 1), (5, 3), (300, 2**20), (1000, 999), (700, 2**64 - 1), (400, 2**33)])
def test_sequences(n, most):
    rng = random.Random(n)
    values = sorted(rng.randint(0, most) for _ in range(n))
    sequence = EliasFano(np.array(values, np.uint64))
    assert sequence.access(np.arange(n)).tolist() == values
    asked = [0, 1, most, 2**64 - 1, *(rng.randint(0, most) for _ in range(200)), *values[:100]]
    at, equal = sequence.successor(np.array(asked, np.uint64))
    assert at.tolist() == [bisect.bisect_left(values, x) for x in asked]
    assert equal.tolist() == [x in set(values) for x in asked]


def level_of(pairs, contexts):
    keys = sorted(pairs)
    return Level(contexts, np.array([a for a, _ in keys], np.int64), np.array([b for _, b in keys], np.uint64), np.array([pairs[k] for k in keys], np.uint8))


def test_level():
    rng = random.Random(6)
    pairs = {(rng.randrange(3, 35), rng.randrange(2**40)): rng.randrange(1, 256) for _ in range(900)}
    pairs |= {(rng.randrange(3, 35), rng.randrange(5)): 7 for _ in range(60)}
    level = level_of(pairs, 40)
    keys = sorted(pairs)
    asked = keys + [(rng.randrange(40), rng.randrange(2**40)) for _ in range(500)] + [(a, b) for a in range(-1, 40) for b in range(5)]
    asked += [(a, b) for a in range(40) for _, b in keys[::90]]
    places = level.find(np.array([a for a, _ in asked]), np.array([b for _, b in asked], np.uint64))
    at = {k: i for i, k in enumerate(keys)}
    assert places.tolist() == [at.get(k, -1) for k in asked]
    assert level.code(places).tolist() == [pairs.get(k, 0) for k in asked]
    # The pointers bound each context's range.
    bounds = level.pointers.access(np.arange(41)).tolist()
    assert bounds == [bisect.bisect_left(keys, (a,)) for a in range(41)]
    small = level.elements.access(np.arange(len(keys)))[-1]
    assert small < 40 * len(level.words.access(np.arange(level.words.n)))


def test_empty_level():
    level = level_of({}, 3)
    assert level.find(np.array([0, 2, -1]), np.array([1, 0, 5], np.uint64)).tolist() == [-1, -1, -1]


def test_trie():
    contexts = np.array([3, 9, 2**63], np.uint64)
    pairs = level_of({(0, 5): 11, (0, 8): 12, (2, 5): 13}, 3)
    triples = level_of({(1, 4): 21, (2, 4): 22, (2, 6): 23}, 3)
    trie = Trie(contexts, pairs, triples)
    of = trie.context(np.array([3, 3, 9, 2**63, 4], np.uint64))
    assert of.tolist() == [0, 0, 1, 2, -1]
    two = trie.pairs.find(of, np.array([8, 6, 5, 5, 5], np.uint64))
    assert two.tolist() == [1, -1, -1, 2, -1]
    three = trie.triples.find(two, np.array([4, 4, 4, 6, 4], np.uint64))
    assert trie.triples.code(three).tolist() == [21, 0, 0, 23, 0]


def test_large_counts():
    counts = np.array([0, 254, 255, 3, 100_000])
    small, large = lm._small(counts)
    assert small.tolist() == [0, 254, 255, 3, 255] and large.tolist() == [255, 100_000]


def tokens(text):
    low = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    return [*low.split(), None]


def plain(rows, k=lm.K):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows}
    one, two, three, first = Counter(), Counter(), Counter(), Counter()
    for d, text in rows:
        if not held[d]:
            t = tokens(text)
            one.update(t)
            two.update(zip(["", *t], t))
            three.update(zip(["", *t], t, t[1:]))
            first.update(["", *t])
    n, v = sum(one.values()), len(one)
    out = []
    for d, text in rows:
        t = tokens(text)
        single = [(one[x] + 0.5) / (n + 0.5 * (v + 1)) for x in t]
        both = [(two[a, x] + k * p) / (first[a] + k) for a, x, p in zip(["", *t], t, single)]
        both[1:] = [(three[c] + k * p) / (two[c[:2]] + k) for c, p in zip(zip(["", *t], t, t[1:]), both[1:])]
        base, score = sum(map(math.log10, single)), sum(map(math.log10, both))
        out.append((d, held[d], len(t), sum(one[x] > 0 for x in t), n, base, score))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, block int, score string")
    found = sorted(map(tuple, lm.scores(docs).collect()), key=repr)
    wanted = sorted(plain(rows), key=repr)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    for f, w in zip(found, wanted):
        assert f[5] == pytest.approx(w[5], rel=1e-12) and f[6] == pytest.approx(w[6], abs=0.04 * w[2] + 1e-9)


def test_against_counting(spark):
    rng = random.Random(1)
    vocabulary = ["the"] * 30 + [f"w{i}" for i in range(60)] + ["É", "THE", "a\x85b"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(200)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \x0b "), (3, "a a a"), (3, "a a a"), (None, "b a"), (7, "word " * 30_000)]
    check(spark, rows)
    check(spark, [(i, "x y") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1])
    assert lm.scores(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_held_out_texts_score_better_than_by_frequency(spark):
    rows = lm.op5_language_model(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_third_words_count(spark):
    """A word that only the last two words decide."""
    line = " ".join(["a x c", "b x d"] * 30)
    rows = [(i, line) for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(60, 200) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs = spark.createDataFrame([*rows, (held, "a x c b x d"), (held, "a x d b x c")], "doc_id bigint, text string")
    right, wrong = sorted((r.score for r in lm.scores(docs).filter("held_out").collect()), reverse=True)
    assert right - wrong > 3


def test_hot_words_are_cut_by_the_next(spark):
    """One word that most bigrams begin with, in more shards than one."""
    rng = random.Random(9)
    rows = [(i, " ".join(x for _ in range(80) for x in ("of", f"w{rng.randrange(300)}", "of", "of"))) for i in range(150)]
    check(spark, rows)
