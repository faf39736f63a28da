"""Row keys, hash buckets and replayable uniform draws.

Every random choice in the package is a function of ``(seed, draw, record_id)``
and never of row order, partition layout or task retries.  A record id is hashed
once by the JVM; the draws made from that key are a few integer operations, so
Catalyst, NumPy and any SQL engine with ``md5`` compute identical doubles.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647  # 2^31 - 1
_HALF_BITS = 28
_HALF_MASK = (1 << _HALF_BITS) - 1


def _hex_word(text: Column, start: int) -> Column:
    """14 hex digits of md5(text), as a non-negative bigint below 2^56."""
    return F.conv(F.substring(F.md5(text), start, 14), 16, 10).cast("bigint")


def row_key(record_id: Column) -> Column:
    """56-bit key of a record id of any type; source of the uniform draws."""
    return _hex_word(record_id.cast("string"), 1)


def hash_bucket(record_id: Column, n_buckets: int) -> Column:
    """Bucket in ``0..n_buckets-1``, from digits the row key does not use."""
    word = _hex_word(record_id.cast("string"), 15)
    return F.pmod(word, F.lit(n_buckets).cast("bigint")).cast("int")


def salted_key(record_id: Column, seed: int) -> Column:
    """56-bit sort key that changes with the seed (exact sampling)."""
    return _hex_word(F.concat_ws(":", F.lit(str(seed)), record_id.cast("string")), 1)


def draw_constants(seed: int, draw: int) -> tuple[int, int, int, int]:
    """Four 28-bit constants that tell one draw from another."""
    digest = hashlib.md5(f"{seed}:{draw}".encode()).hexdigest()
    return tuple(int(digest[i : i + 7], 16) for i in (0, 7, 14, 21))


def uniform(key: Column, seed: int, draw: int) -> Column:
    """Uniform double in (0, 1] for a row key, as a codegen-able expression."""
    s1, s2, s3, s4 = draw_constants(seed, draw)
    high = F.shiftright(key, _HALF_BITS)
    low = key.bitwiseAND(F.lit(_HALF_MASK))
    z1 = ((high + s1) * (low + s2)) % PRIME
    z2 = ((high + s3) * (low + s4)) % PRIME
    return (z1 + (z2 + 0.5) / PRIME) / PRIME


def uniform_array(keys: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """The same draw for an array of row keys."""
    s1, s2, s3, s4 = draw_constants(seed, draw)
    high = keys >> _HALF_BITS
    low = keys & _HALF_MASK
    z1 = ((high + s1) * (low + s2)) % PRIME
    z2 = ((high + s3) * (low + s4)) % PRIME
    return (z1 + (z2 + 0.5) / PRIME) / PRIME
