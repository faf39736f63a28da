"""Minimal perfect hashes of term sets, sharded, with the keys stored for verification.

A shard is built in levels: the keys of a level are hashed into a bit array, and those that
are alone at their place set its bit; the others go to the next level.  A key's slot is the
number of bits set before its own, over all levels of its shard, so the slots of n keys are
0 to n - 1.  What a slot holds is stored beside the bits, because a hash that was never
built from a key still sends it to some slot.

Keys longer than LONGEST_STORED bytes are stored as a digest, so a shard's size is bounded
by its number of keys.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LONGEST_STORED = 128
BITS_PER_KEY = 2  # of a level
MOST_LEVELS = 64
_GOLDEN = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)


def key_hashes(space: bytes, terms: list[bytes]) -> np.ndarray:
    """One 64-bit hash of each term of a space (say, a language)."""
    seed = xxhash.xxh3_64_intdigest(space)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(t, seed) for t in terms), np.uint64, len(terms))


def stored_key(space: bytes, term: bytes) -> bytes:
    """What is stored of a key; a term of any length is told from any other."""
    key = len(space).to_bytes(4, "big") + space + term
    return key if len(key) <= LONGEST_STORED else b"\xff\xff\xff\xff" + hashlib.sha256(key).digest()


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    """An independent hash for each level."""
    x = hashes + np.uint64((level + 1) * _GOLDEN % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of each level, bytes of bits, slot of each key) of different hashes."""
    open_ = np.arange(len(hashes))
    widths, levels, places = [], [], np.zeros(len(hashes), np.int64)
    base = 0
    while len(open_):
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys have the same hash")
        width = -(-BITS_PER_KEY * len(open_) // 64) * 64
        at = (_mixed(hashes[open_], len(levels)) % np.uint64(width)).astype(np.int64)
        alone = np.bincount(at, minlength=width) == 1
        settled = alone[at]
        places[open_[settled]] = base + at[settled]
        levels.append(alone)
        widths.append(width)
        base += width
        open_ = open_[~settled]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    before = np.cumsum(bits) - bits
    return np.array(widths, np.int64), np.packbits(bits, bitorder="little"), before[places].astype(np.int64)


@dataclass(frozen=True)
class Shard:
    """A shard as it is stored: its number, level widths, bits, and keys in the order of slots."""

    number: int
    widths: np.ndarray
    bits: bytes
    keys: pa.Array


class PerfectHashes:
    """Several shards, asked together; a key belongs to shard ``hash >> shift``'s remainder."""

    def __init__(self, shards: list[Shard], first_slots: dict[int, int], n_shards: int):
        self.n_shards = n_shards
        levels = max((len(s.widths) for s in shards), default=0)
        self.row_of = np.full(n_shards, -1, np.int64)
        self.width = np.zeros((len(shards), levels), np.uint64)
        self.start = np.zeros((len(shards), levels), np.int64)
        self.local = np.zeros(len(shards), np.int64)  # set bits, and keys, before a shard
        self.first = np.zeros(len(shards), np.int64)  # the slot that its first key has among all shards
        words, keys, at, held = [], [], 0, 0
        for row, shard in enumerate(shards):
            self.row_of[shard.number] = row
            self.first[row] = first_slots[shard.number]
            self.local[row] = held
            for level, width in enumerate(shard.widths.tolist()):
                self.width[row, level] = width
                self.start[row, level] = at
                at += width
            words.append(np.frombuffer(shard.bits, "<u8"))
            keys.append(shard.keys.cast(pa.large_binary()))
            held += len(shard.keys)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.keys = pa.concat_arrays(keys) if keys else pa.array([], pa.large_binary())

    def slots(self, hashes: np.ndarray, keys: list[bytes]) -> np.ndarray:
        """The slot of each key among all shards, -1 for keys that are not stored."""
        found = np.full(len(hashes), -1, np.int64)
        row = self.row_of[shard_of(hashes, self.n_shards)]
        open_ = np.flatnonzero(row >= 0)
        for level in range(self.width.shape[1]):
            open_ = open_[self.width[row[open_], level] > 0]
            if not len(open_):
                break
            own = row[open_]
            bit = self.start[own, level] + (_mixed(hashes[open_], level) % self.width[own, level]).astype(np.int64)
            word, place = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> place) & _ONE == _ONE
            below = np.bitwise_count(word[hit] & ((_ONE << place[hit]) - _ONE)).astype(np.int64)
            found[open_[hit]] = self.before[bit[hit] >> 6] + below
            open_ = open_[~hit]
        asked = np.flatnonzero(found >= 0)
        stored = self.keys.take(pa.array(found[asked]))
        same = pc.equal(stored, pa.array([keys[i] for i in asked.tolist()], pa.large_binary()))
        found[asked[~same.to_numpy(zero_copy_only=False)]] = -1
        asked = asked[same.to_numpy(zero_copy_only=False)]
        found[asked] += self.first[row[asked]] - self.local[row[asked]]
        return found


def shard_of(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(n_shards)).astype(np.int64)
