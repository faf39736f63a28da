"""Spans against brute force, and the edge cases."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from centroidal.llm import substring_dedup as dedup
from centroidal.llm.common import documents


def plain(rows, least_sentences=3, least_words=12):
    """The definition, span by span: rows in the order of ids; equal rows one after the other."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        parts = dedup.sentences(text)
        solid = [i for i, p in enumerate(parts) if p.strip()]
        gone = set()
        for i in range(len(solid)):
            for k in range(i + least_sentences, len(solid) + 1):
                run = tuple(parts[j].strip() for j in solid[i:k])
                if sum(len(s.split()) for s in run) >= least_words:
                    if run in seen:
                        gone.update(solid[i:k])
                    seen.add(run)
                    break
        kept = "".join(p for i, p in enumerate(parts) if i not in gone) if gone else text
        out.append((doc_id, len(solid), len(gone), kept))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, block int, shard string")
    return sorted(map(tuple, dedup.deduplicated(docs, **options).drop("carried").collect()), key=repr)


def passages(seed, docs=120):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) + rng.choice([".", "!", ",", ".\n", "?! "]) for _ in range(150)]
    hot = pool[:8]
    rows = []
    for i in range(docs):
        parts = rng.choices(pool, k=rng.randrange(0, 40))
        if i % 3 == 0:
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = hot
        rows.append((i * 7 % docs, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = passages(seed)
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, least_sentences=2, least_words=5) == plain(rows, 2, 5)


def test_odd_rows(spark):
    long = " ".join(f"word{i} is here, and so on." for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\n ..."), (4, long), (5, long), (5, long), (None, long), (6, "Too short."), (7, "Too short."), (None, None)]
    rows += [(8, "a a a a a. b b b b b. c c c c c. " * 4), (9, "no marks at all " * 50)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_other_columns_are_carried(spark):
    docs = spark.createDataFrame([(1, "a", "b c.", None), (2, None, "", 4)], "doc_id bigint, block string, text string, shard int")
    found = {r.doc_id: r.carried for r in dedup.deduplicated(docs).collect()}
    assert tuple(found[1]) == ("a", None) and tuple(found[2]) == (None, 4)


def test_small_table_of_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = plain(rows)
    assert sorted(map(tuple, dedup.op1_substring_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr) == wanted
    assert any(n for _, _, n, _ in wanted)


@given(st.text(alphabet="ab .!,\n;"))
def test_sentences_join_to_the_text(text):
    assert "".join(dedup.sentences(text)) == text


def test_letters_do_not_depend_on_the_number_of_shards():
    """A block sorts its spans by shard once: many shards cost hardly more than few, and hold the same spans."""
    rng = random.Random(2)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(500)}{rng.choice(['', '', '.'])}" for _ in range(400)) for _ in range(200)]
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    seconds, held = {}, {}
    for shards in (32, 62_500):
        block = dedup._Block(rows, shards, 3, 12)
        began = time.process_time()
        letters = dict(block.letters())
        found = [block.of_shard(s) for s in letters]
        seconds[shards] = time.process_time() - began
        held[shards] = sorted(np.concatenate(found).tolist())
        assert [len(x) // 24 for x in letters.values()] == list(map(len, found))
        assert all((block.hashes[own, 0] % np.uint64(shards) == s).all() for s, own in zip(letters, found))
    assert held[32] == held[62_500] and len(held[32]) > 5000
    assert seconds[62_500] < 1.0
