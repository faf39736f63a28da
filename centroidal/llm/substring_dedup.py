"""Substring deduplication by sliding sentence spans.

A sentence ends at any of ``. ! ? , ; :``, a mark of another script, or at a line end, so a
passage pasted into another sentence still has sentences of its own.  Long sentences are cut
further after words that a hash picks, so equal passages are cut equally wherever they stand,
marks or none; in scripts without spaces letters are words.  A span is the shortest run, from each sentence on,
of at least SENTENCES sentences and WORDS words.  Spans are hashed (128 bits, over the
sentences without outer white space) and compared over the whole table.  The first
occurrence of a span, by document id and place, stays; the sentences of all others go.  Every
sentence that goes has an earlier copy in the same surroundings, so one copy always stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from centroidal.llm.blocks import answered, block_rows, dealt, letters_of, partitions_of, read_back, text_bytes, with_carried
from centroidal.llm.common import documents, ids_and_texts, sole_memory

SENTENCES = 3
WORDS = 12
SHARD_BYTES = 16_000_000  # of text for a shard of the span index
_MARKS = r".!?,;:\n。！？，、；：．।॥؟؛،۔።፣…"
_SENTENCE = re.compile(f"[^{_MARKS}]+[{_MARKS}]*|[{_MARKS}]+")
# Thai, Lao, Myanmar, Khmer, kana and Han: letters that stand without spaces.
_LETTERS = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿\U00020000-\U0003ffff"
_WORD = re.compile(rf"^\s+|[{_LETTERS}]\s*|[^\s{_LETTERS}]+\s*")
EDGE = 3  # words from a sentence's ends within which it is not cut
KNOWN_WORDS = 500_000
LAST = np.iinfo(np.int64).max  # where null ids stand

# Odd multipliers, one for each half of the hash, and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)])[:n]


class _Cuts(dict):
    """Whether a long sentence is cut after a word: after one in four, of letters without spaces one in two."""

    def __missing__(self, word: str) -> bool:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        plain = word.strip()
        one_in = 2 if len(plain) == 1 and not plain.isascii() else 4
        self[word] = cut = xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) % one_in == 0
        return cut


_cuts = _Cuts()
_cut_after = _cuts.__getitem__


def sentences(text: str | None) -> list[str]:
    """The text in pieces that join to it again."""
    out = []
    for part in _SENTENCE.findall(text or ""):
        # So many words have so many characters at least.
        words = _WORD.findall(part) if len(part) > 2 * EDGE else ()
        if len(words) <= 2 * EDGE:
            out.append(part)
            continue
        lead = words[0].isspace()
        start = 0
        for k, cut in enumerate(map(_cut_after, words[EDGE - 1 + lead : len(words) - EDGE]), EDGE + lead):
            if cut:
                out.append("".join(words[start:k]))
                start = k
        out.append("".join(words[start:]))
    return out


class Spans:
    """The spans of one text: where each begins and ends, in sentences, and its two hashes."""

    def __init__(self, parts: list[str], least_sentences: int, least_words: int):
        trimmed = [p.strip() for p in parts]
        self.places = np.flatnonzero(np.fromiter(map(bool, trimmed), bool, len(trimmed)))
        solid = [t for t in trimmed if t]
        words = np.fromiter((len(t.split()) for t in solid), np.int64, len(solid))
        before = np.r_[0, np.cumsum(words)]
        n = len(solid)
        ends = np.maximum(np.searchsorted(before, before[:-1] + least_words), np.arange(n) + least_sentences)
        self.starts = np.flatnonzero(ends <= n)
        self.ends = ends[self.starts]
        if not len(self.starts):
            self.hashes = np.zeros((0, 2), np.uint64)
            return
        digest = xxhash.xxh3_128_digest
        halves = np.frombuffer(b"".join([digest(t.encode("utf-8", "surrogatepass")) for t in solid]), "<u8").reshape(-1, 2)
        hashes = []
        for half, base in enumerate(_BASES):
            # Sums of hash times power; a run's sum is moved back to power 0 by the inverse.
            sums = np.r_[np.uint64(0), np.cumsum(halves[:, half] * _powers(base, n), dtype=np.uint64)]
            back = _powers(pow(base, -1, 1 << 64), n)
            hashes.append((sums[self.ends] - sums[self.starts]) * back[self.starts])
        self.hashes = np.stack(hashes, axis=1)


class _Block:
    """A block's texts, their spans, and its distinct spans by shard."""

    def __init__(self, rows: pa.Table, shards: int, least_sentences: int, least_words: int):
        sole_memory("substring_dedup", _cuts.clear)
        self.order, self.ids, self.texts = block_rows(rows)
        self.parts = [sentences(t) for t in self.texts]
        self.spans = [Spans(p, least_sentences, least_words) for p in self.parts]
        hashes = np.concatenate([s.hashes for s in self.spans]) if self.spans else np.zeros((0, 2), np.uint64)
        self.owner = np.repeat(np.arange(len(self.spans)), [len(s.starts) for s in self.spans])
        order = np.lexsort((np.arange(len(hashes)), hashes[:, 1], hashes[:, 0]))
        fresh = np.ones(len(hashes), bool)
        if len(hashes):
            ordered = hashes[order]
            fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        first = np.zeros(len(hashes), bool)
        first[order] = fresh
        self.goes = ~first  # a later one of the same block
        self.hashes = hashes
        own = np.flatnonzero(first)  # in the order of rows and places
        shard = (hashes[own, 0] % np.uint64(shards)).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        self.first, shard = own[by_shard], shard[by_shard]
        self.shards, starts = np.unique(shard, return_index=True)
        self.bounds = np.r_[starts, len(shard)]

    def of_shard(self, shard: int) -> np.ndarray:
        """The block's first spans in a shard that it has spans of, in the order of rows and places."""
        at = np.searchsorted(self.shards, shard)
        return self.first[self.bounds[at] : self.bounds[at + 1]]

    def letters(self) -> Iterator[tuple[int, bytes]]:
        ids = np.array([LAST if i is None else i for i in self.ids], np.int64)
        for shard in self.shards.tolist():
            own = self.of_shard(shard)
            yield shard, self.hashes[own].tobytes() + ids[self.owner[own]].tobytes()


def _first_elsewhere(blocks: list[int], letters: list[bytes]) -> list[bytes]:
    """For each letter, the numbers of its spans of which another block has an earlier one."""
    sizes = [len(x) // 24 for x in letters]
    hashes = np.concatenate([np.frombuffer(x, "<u8", 2 * n) for x, n in zip(letters, sizes)]).reshape(-1, 2)
    ids = np.concatenate([np.frombuffer(x, "<i8", n, 16 * n) for x, n in zip(letters, sizes)])
    source = np.repeat(np.arange(len(letters)), sizes)  # letters come in the order of blocks
    order = np.lexsort((source, ids, hashes[:, 1], hashes[:, 0]))
    ordered = hashes[order]
    later = np.zeros(len(order), bool)
    later[order[1:]] = (ordered[1:] == ordered[:-1]).all(axis=1)
    starts = np.cumsum(sizes) - sizes
    return [np.flatnonzero(later[s : s + n]).astype("<u4").tobytes() for s, n in zip(starts, sizes)]


def deduplicated(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """``(doc_id, n_sentences, n_removed, text)`` and the struct ``carried`` of all other columns.

    One row per row of ``docs``.  ``text`` is the text without the removed sentences, or the
    text itself where none is.  Texts shorter than a span, empty and null texts stay as they
    are.  A repeated row is a later occurrence of all its spans; rows with a null id come
    after all others.
    """
    plain = with_carried(docs, [c for c in docs.columns if c not in ("doc_id", "text")])
    total = text_bytes(plain)
    shards = max(partitions_of(docs), -(-total // SHARD_BYTES))
    by_block = dealt(plain, total)

    def write(block: int, rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        return _Block(rows, shards, least_sentences, least_words).letters()

    def read(block: int, rows: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        own = _Block(rows, shards, least_sentences, least_words)
        goes = own.goes
        for shard, numbers in answers.items():
            goes[own.of_shard(shard)[np.frombuffer(numbers, "<u4")]] = True
        cuts = np.searchsorted(own.owner, np.arange(len(own.ids) + 1))
        texts, removed, counts = [], [], []
        for i, (parts, spans, text) in enumerate(zip(own.parts, own.spans, own.texts)):
            gone = goes[cuts[i] : cuts[i + 1]]
            n = len(spans.places)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, spans.starts[gone], 1)
            np.add.at(cover, spans.ends[gone], -1)
            out = set(spans.places[np.cumsum(cover)[:n] > 0].tolist())
            texts.append("".join(p for k, p in enumerate(parts) if k not in out) if out else text)
            removed.append(len(out))
            counts.append(n)
        columns = [own.ids, counts, removed, texts]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        carried = rows.column("carried").combine_chunks().take(pa.array(own.order, pa.int64()))
        return pa.Table.from_arrays([*arrays, carried], ["doc_id", "n_sentences", "n_removed", "text", "carried"])

    replies = answered(letters_of(by_block, write), _first_elsewhere, shards)
    schema = StructType.fromDDL("doc_id bigint, n_sentences bigint, n_removed bigint, text string")
    return read_back(by_block, replies, read, schema.add(plain.schema["carried"]))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(ids_and_texts(documents(spark, sf_dir))).drop("carried")
