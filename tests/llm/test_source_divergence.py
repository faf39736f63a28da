"""The recount over perfect hashes against plain counting, and the hashes by themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from centroidal.llm.perfect_hash import PerfectHashes, Shard, build, key_hashes, shard_of, stored_key
from centroidal.llm.source_divergence import _rounds, source_divergences, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_version(rows, least, top=10):
    docs = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    result = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= least]
        counts = defaultdict(Counter)
        for name, source, terms in docs:
            if name == lang:
                counts[source].update(terms)
        whole = sum(counts.values(), Counter())

        def shares(found):
            total = sum(found[t] for t in kept)
            return {t: 1 + 10**9 * (found[t] + 2) // (total + 2 * len(kept)) for t in kept}

        by_source = {s: shares(c) for s, c in counts.items()}
        q = shares(whole)
        for source, p in by_source.items():
            parts = {"pair": [], "term": []}
            for other, r in by_source.items():
                if other != source:
                    parts["pair"].append((other, sum((p[t] - r[t]) ** 2 // (p[t] + r[t]) for t in kept)))
            for t in kept:
                if counts[source][t] and p[t] > q[t]:
                    parts["term"].append((t, (p[t] - q[t]) ** 2 // (p[t] + q[t])))
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                result += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(result)


def random_rows(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdéß漢🙂" for b in ("", "x", "Y", "zz", "ü")]
    langs, sources = ["de", "en", None, ""], ["s0", "s0", "s0", "s1", "s2", None, "ž", "S1"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "1", "\n", "_", ""]) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(langs), rng.choice(sources)))
    return rows


def table(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, term string, n int, slot string"
    return spark.createDataFrame([(*r, "t", 1, "s") for r in rows], schema).repartition(5)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_against_plain_counting(spark):
    rows = random_rows(300)
    rows += [rows[0]] * 12  # repeated rows are documents
    rows += [(None, None, "de", "empty"), (None, "", "fr", "alone"), (None, "1 2 3", "it", "a"), (None, "!", "it", "b")]
    long_term = "q" * 300_000  # longer than what is stored as it is
    rows += [(1000 + i, long_term + (" " + long_term[:-1] if i % 2 else ""), "de", f"s{i % 3}") for i in range(14)]
    rows += [(2000, "common " * 200_000, "en", "s0")]
    assert found(source_divergences(table(spark, rows), 5)) == plain_version(rows, 5)


def test_small_shards_rounds_and_blocks(spark):
    """Several rounds of shards, dense arrays sent on early, and more sources than a block holds."""
    rows = [(i, t, lang, f"{s}-{i % 4}") for i, t, lang, s in random_rows(200, 2)]
    limits = {"keys_per_shard": 3, "round_bytes": 300, "dense_slots": 20, "chunk_slots": 4, "block_sources": 3}
    assert found(source_divergences(table(spark, rows), 3, 4, **limits)) == plain_version(rows, 3, 4)


def test_nothing_kept_and_empty_table(spark):
    rows = random_rows(12, 3)
    assert found(source_divergences(table(spark, rows), 1000)) == plain_version(rows, 1000)
    assert source_divergences(table(spark, rows).limit(0)).collect() == []


def test_terms():
    text = "Don't ÄÖ-x1y_Z 漢字,a\x7fb\x00c"
    assert [t.decode() for t in terms_of(text.encode())] == TERM.findall("don't ÄÖ-x1y_z 漢字,a\x7fb\x00c")


def index_of(terms, n_shards):
    hashes = key_hashes(b"x", terms)
    shards, firsts, slot = [], {}, 0
    for number in range(n_shards):
        own = np.flatnonzero(shard_of(hashes, n_shards) == number)
        widths, bits, slots = build(hashes[own])
        keys = [stored_key(b"x", terms[own[i]]) for i in np.argsort(slots)]
        shards.append(Shard(number, widths, bits.tobytes(), pa.array(keys, pa.binary())))
        firsts[number] = slot
        slot += len(own)
    return shards, firsts


@pytest.mark.parametrize(("n", "n_shards"), [(0, 1), (1, 1), (1000, 1), (20_000, 7)])
def test_slots_are_minimal_and_perfect(n, n_shards):
    terms = [f"term{i}".encode() for i in range(n)]
    shards, firsts = index_of(terms, n_shards)
    whole = PerfectHashes(shards, firsts, n_shards)
    slots = whole.slots(key_hashes(b"x", terms), [stored_key(b"x", t) for t in terms])
    assert sorted(slots.tolist()) == list(range(n))
    others = [f"other{i}".encode() for i in range(500)]
    assert (whole.slots(key_hashes(b"x", others), [stored_key(b"x", t) for t in others]) == -1).all()
    # The same terms of another language are other keys.
    assert (whole.slots(key_hashes(b"y", terms), [stored_key(b"y", t) for t in terms]) == -1).all()
    # Of two rounds each term is in one.
    halves = [PerfectHashes(part, firsts, n_shards) for part in (shards[: n_shards // 2], shards[n_shards // 2 :])]
    keys = [stored_key(b"x", t) for t in terms]
    both = np.maximum(*[h.slots(key_hashes(b"x", terms), keys) for h in halves])
    assert (both == slots).all()


def test_wrong_keys_are_told_by_what_is_stored():
    """A hash that another key has is not enough."""
    terms = [f"term{i}".encode() for i in range(100)]
    shards, firsts = index_of(terms, 1)
    keys = [stored_key(b"x", b"other" + t) for t in terms]
    assert (PerfectHashes(shards, firsts, 1).slots(key_hashes(b"x", terms), keys) == -1).all()


def test_rounds():
    assert _rounds([(0, 5), (1, 5), (2, 1), (3, 20), (4, 1)], 10) == [[0, 1], [2], [3], [4]]
    assert _rounds([], 10) == []
