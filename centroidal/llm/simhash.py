"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a midpoint within half the radius of both.  So
every distinct fingerprint stands for all variants within half the radius, and equal
variants are the candidates.  The 2081 variants of a 64-bit fingerprint are not sent one by
one: the shuffle key of a variant is its low ``KEY_BITS`` bits, and a fingerprint travels
once to each of the 137 keys that its variants have; they are written out where they meet.

Fingerprints that share a variant are all within the radius of one another, so linking each
to the smallest of them keeps every connection, and the number of links stays linear in
large groups.  Each link is verified.  A task sends on only links that join what it has not
yet joined.  Connected components of the fingerprints, then of documents, follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.llm.common import ASCII_LOWER, documents, ids_and_texts, text_slices, text_version, written
from centroidal.llm.components import components

BITS = 64
WORDS = 4
SEED = 42
RADIUS = 4
LEAST_KEY_BITS, MOST_KEY_BITS = 8, 24
PRINTS_PER_KEY = 32
CHUNK_VARIANTS = 3_000_000  # held by a task at once

# For each byte value, its 8 bits in 8 bytes, the highest first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view("<u8").ravel()


def shingles(text: str | None, words: int = WORDS) -> list[bytes]:
    """Space-joined runs of ``words`` words, repeats included; fewer words are one run, none give none."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [joined[s:e] for s, e in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())]


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is set where it is set in over half of the shingles' hashes; no words give zero."""
    parts = shingles(text, words)
    if not parts:
        return 0
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(p, seed) for p in parts]), np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 255):  # a byte can count so far
        some = hashes[start : start + 255]
        counts += _SPREAD[some].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _printed(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """``(doc_id, version bigint, fingerprint bigint)``; the version is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_slices(batch):
                found = pa.array([_signed(fingerprint(t, words, seed)) for t in texts], pa.int64())
                rows = batch.slice(start, end - start)
                columns = [rows.column("doc_id"), rows.column("version"), found]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "fingerprint"])

    versions = ids_and_texts(docs).withColumn("version", text_version(F.col("text")))
    return versions.mapInArrow(run, "doc_id bigint, version bigint, fingerprint bigint")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fingerprint bigint)``: the 64 bits as a signed number."""
    return _printed(docs, words, seed).select("doc_id", "fingerprint")


def flips(bits: range, most: int) -> np.ndarray:
    """All masks of at most ``most`` of these bits, by their number."""
    masks = [sum(1 << b for b in some) for k in range(most + 1) for some in combinations(bits, k)]
    return np.array(masks, np.uint64)


def _low(key_bits: int) -> np.uint64:
    return np.uint64((1 << key_bits) - 1)


def _addressed(distinct: DataFrame, half: int, key_bits: int) -> DataFrame:
    """``(key, fingerprint)``: a fingerprint once for each key that its variants have."""
    masks = flips(range(key_bits), half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(prints), 4096):
                some = prints[start : start + 4096]
                keys = (some[:, None] ^ masks) & _low(key_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().astype(np.int32)), pa.array(np.repeat(some, len(masks)).view(np.int64))],
                    ["key", "fingerprint"],
                )

    return distinct.mapInArrow(run, "key int, fingerprint bigint")


class _Forest:
    """Union-find; ``join`` tells whether two fingerprints were apart."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def _find(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self._find(a), self._find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _variants(
    keys: np.ndarray, prints: np.ndarray, half: int, key_bits: int, part: int, parts: int
) -> tuple[np.ndarray, np.ndarray]:
    """Variants with these keys, and the place of the fingerprint each comes from."""
    low = _low(key_bits)
    base = (prints & ~low) | keys
    used = np.bitwise_count((prints & low) ^ keys)
    variants, owners = [], []
    for k in range(half + 1):
        own = np.flatnonzero(used == k)
        masks = flips(range(key_bits, BITS), half - k)
        for start in range(0, len(own), 1024):
            some = own[start : start + 1024]
            made = (base[some, None] ^ masks).ravel()
            owner = np.repeat(some, len(masks))
            if parts > 1:
                mine = (made * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == part
                made, owner = made[mine], owner[mine]
            variants.append(made)
            owners.append(owner)
    return np.concatenate(variants), np.concatenate(owners)


def _shared(keys: np.ndarray, prints: np.ndarray, half: int, key_bits: int) -> np.ndarray:
    """Pairs (fingerprint, smallest fingerprint with the same variant), each once.

    A crowded key is worked off in parts, each with its share of the variants.
    """
    own = int((prints & _low(key_bits) == keys).sum()) * len(flips(range(key_bits, BITS), half))
    parts = max(1, -(-own // CHUNK_VARIANTS))
    found = []
    for part in range(parts):
        variants, owners = _variants(keys, prints, half, key_bits, part, parts)
        # Only variants that fall in a cell with another one are worth sorting.
        cells = (variants * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)
        crowded = np.bincount(cells, minlength=1 << 22)[cells] > 1
        variants, members = variants[crowded], prints[owners[crowded]]
        order = np.lexsort((members, variants))
        variants, members = variants[order], members[order]
        if not len(variants):
            continue
        starts = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
        lowest = np.repeat(members[starts], np.diff(np.r_[starts, len(variants)]))
        found.append(np.unique(np.stack([members, lowest], 1)[members != lowest], axis=0))
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``, a > b: enough pairs of fingerprints within the radius to connect all such pairs."""
    half = (radius + 1) // 2
    key_bits = min(MOST_KEY_BITS, max(LEAST_KEY_BITS, (distinct.count() // PRINTS_PER_KEY).bit_length()))
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _addressed(distinct, half, key_bits).repartition(2 * partitions, "key").sortWithinPartitions("key")
    most = CHUNK_VARIANTS // 30

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held_keys, held = _Forest(), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def joined(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            pairs = _shared(keys, prints, half, key_bits)
            pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius].view(np.int64)
            tree = [(max(p), min(p)) for p in pairs.tolist() if forest.join(*p)]
            a, b = zip(*tree) if tree else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held_keys = np.r_[held_keys, batch.column("key").to_numpy().astype(np.uint64)]
            held = np.r_[held, batch.column("fingerprint").to_numpy().view(np.uint64)]
            while len(held) > most and held_keys[0] != held_keys[-1]:
                cut = int(np.searchsorted(held_keys, held_keys[min(most, len(held) - 1)]))
                cut = cut or int(np.searchsorted(held_keys, held_keys[0], "right"))
                yield joined(held_keys[:cut], held[:cut])
                held_keys, held = held_keys[cut:], held[cut:]
        if len(held):
            yield joined(held_keys, held)

    return met.mapInArrow(run, "a bigint, b bigint")


def _grouped(docs: DataFrame, words: int, radius: int, seed: int) -> DataFrame:
    """``(doc_id, version, fingerprint, first)``; ``first`` is the group's smallest id and version, null ids last."""
    printed = written(_printed(docs, words, seed), "simhash")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")
    distinct = written(printed.groupBy("fingerprint").agg(F.min(own).alias("own_first")), "simhash-distinct")
    roots = components(links(distinct.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    root = F.coalesce("root", "fingerprint").alias("root")
    rooted = written(distinct.join(roots, "fingerprint", "left").select("fingerprint", "own_first", root), "simhash-roots")
    named = written(rooted.groupBy("root").agg(F.min("own_first").alias("first")), "simhash-names")
    member = written(rooted.join(named, "root").select("fingerprint", "first"), "simhash-members")
    return printed.join(member, "fingerprint")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; the
    component is named by the smallest id that can be reached.  A null or empty text has
    the fingerprint zero.  A null id takes part, but names a component only if all its ids
    are null.  Columns other than id and text are not read; an empty table gives no rows.
    """
    return _grouped(docs, words, radius, seed).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


def superfluous(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``(doc_id, version)`` of the texts of which another one of their group stays.

    A text is named by its id and ``text_version``, so that of texts under one id, or without
    an id, each is decided by itself.  The text with the smallest id stays, then the one with
    the smallest version; null ids come last.  Rows alike in both are one text.
    """
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.version") == F.col("version"))
    return _grouped(docs, words, radius, seed).filter(~stays).select("doc_id", "version").distinct()


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
