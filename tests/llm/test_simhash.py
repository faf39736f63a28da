"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from centroidal.llm.components import components
from centroidal.llm.simhash import fingerprint, links, near_duplicates


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, radius=4):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[:i]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


TEXTS = [None, "", "  \n", "One", "one", "ONE two three", "a b c d", "a b c d e f g É", "word " * 700, "x\x0by\x0cz w v\x85u"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprints(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_spark_hashes_alike(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] == signed(xxhash.xxh64_intdigest(b"a b c d", 42))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_connect_all_within_the_radius(spark, seed):
    rng = random.Random(seed)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):  # balls, chains and loners
        center = rng.getrandbits(64)
        prints.add(center)
        for _ in range(rng.choice([0, 0, 3, 12])):
            flipped = center
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                flipped ^= 1 << b
            prints.add(flipped)
            center = rng.choice([center, flipped])
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint bigint")
    found = links(df).collect()
    wanted = plain_components(prints)
    joined = plain_components(prints, radius=0)
    for a, b in found:
        assert a > b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
    groups = {}
    for node, root in wanted.items():
        groups.setdefault(root, set()).add(node)
    edges = [(r.a, r.b) for r in found]
    rooted = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len(joined) == len(prints)
    for group in groups.values():
        assert {rooted.get(signed(p), signed(p)) for p in group} == {min(map(signed, group))}


def test_components_of_chains_and_hubs(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 999) for i in range(300)] + [(5, 3), (999, 500)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {i: 500 for i in range(999, 1300)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_near_duplicates_table(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices(["red", "green", "blue", "cyan", "grey"], k=k)) for k in (5, 80, 200, 400, 900)]
    texts = TEXTS + base + [b + " end" for b in base] + [b.upper() for b in base]
    rows = [(i * 3 + 1, t, "z") for i, t in enumerate(texts)] + [(4, texts[1], "z"), (4, texts[1], "z"), (None, base[2], "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")
    found = near_duplicates(docs).collect()
    prints = {t: plain_fingerprint(t) for t in {r[1] for r in rows}}
    roots = plain_components(set(prints.values()))
    lowest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            root = roots[prints[text]]
            lowest[root] = min(doc_id, lowest.get(root, doc_id))
    wanted = [(d, f"{prints[t]:016x}", lowest[roots[prints[t]]]) for d, t, _ in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_crowded_keys_are_worked_off_in_parts(monkeypatch):
    from centroidal.llm import simhash

    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 2**20, 400, dtype=np.uint64) << np.uint64(40))
    keys = np.zeros(len(prints), np.uint64)
    whole = simhash._shared(keys, prints, 2, 8)
    monkeypatch.setattr(simhash, "CHUNK_VARIANTS", 50_000)
    assert set(map(tuple, simhash._shared(keys, prints, 2, 8).tolist())) == set(map(tuple, whole.tolist()))
