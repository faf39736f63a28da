"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch are one flat array of symbols with ragged rows.  In each round
every row finds the pair of lowest rank it holds, and all rows merge theirs at once; a row
leaves when it has no pair left, and the symbols that survive are its count.  A new symbol
only takes part in pairs of higher rank, so all places of a row's lowest pair can merge in
the same round, from the left where they overlap.  Equal pieces are merged once per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from centroidal.llm.common import documents, ids_and_texts, text_slices
from centroidal.llm.tokenizer import PRE_TOKEN, Vocabulary, pieces, vocabulary, vocabulary_file

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
KNOWN_PIECES = 400_000  # kept by a task; beyond it, it starts afresh
BATCH_BYTES = 2_000_000  # merged at once
NEVER = np.iinfo(np.int32).max


class RankMerger:
    """Merges ragged rows of symbols of one vocabulary."""

    def __init__(self, words: Vocabulary):
        self.byte_ids = np.array(words.byte_ids, np.int64)
        left, right, made = np.array(words.merges, np.int64).reshape(-1, 3).T
        self.base = words.size
        order = np.argsort(left * self.base + right, kind="stable")
        self.keys = (left * self.base + right)[order]
        self.ranks = order.astype(np.int32)
        self.made = made

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NEVER, np.int32)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def counts(self, rows: list[bytes]) -> np.ndarray:
        """How many symbols are left of each row."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        result = np.zeros(len(rows), np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        row = np.repeat(np.arange(len(rows)), lengths)
        ranks = np.full(len(symbols), NEVER, np.int32)
        inner = np.flatnonzero(row[1:] == row[:-1])
        ranks[inner] = self._rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sizes = np.diff(np.r_[starts, len(row)])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            done = lowest == NEVER
            result[row[starts]] = sizes
            if done.any():
                symbols, row, ranks, lowest = (x[~done] for x in (symbols, row, ranks, lowest))
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == lowest)
            hit = self._apart(hit)
            symbols[hit] = self.made[ranks[hit]]
            kept = np.ones(len(symbols), bool)
            kept[hit + 1] = False
            at = (np.cumsum(kept) - 1)[hit]
            symbols, row, ranks = symbols[kept], row[kept], ranks[kept]
            changed = np.unique(np.r_[at, at[at > 0] - 1])
            last = changed == len(symbols) - 1
            following = np.minimum(changed + 1, len(symbols) - 1)
            inside = ~last & (row[changed] == row[following])
            ranks[changed] = NEVER
            ranks[changed[inside]] = self._rank(symbols[changed[inside]], symbols[following[inside]])
        return result

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Every second place of each run of neighbours: overlapping pairs merge from the left."""
        fresh = np.r_[True, np.diff(hit) != 1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        return hit[(np.arange(len(hit)) - first) % 2 == 0]


class TokenCounter:
    """Counts tokens of texts; remembers the counts of pieces it has seen."""

    def __init__(self, content: bytes, known_pieces: int = KNOWN_PIECES):
        self.words = vocabulary(content)
        self.merger = RankMerger(self.words)
        self.known_pieces = known_pieces
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = _Numbering()
        self.known = np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Merge the pieces that came up since the last call."""
        fresh = list(self.index)[len(self.known) :]
        rows: list[bytes] = []
        owners: list[int] = []
        found = np.zeros(len(fresh), np.int64)
        held = 0
        for number, piece in enumerate(fresh):
            for token in PRE_TOKEN.findall(piece):
                rows.append(token.encode("utf-8", "surrogatepass"))
                owners.append(number)
                held += len(rows[-1])
            if held >= BATCH_BYTES:
                np.add.at(found, owners, self.merger.counts(rows))
                rows, owners, held = [], [], 0
        if rows:
            np.add.at(found, owners, self.merger.counts(rows))
        self.known = np.r_[self.known, found]

    def count(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > self.known_pieces:
            self._forget()
        numbers: list[np.ndarray] = []
        extra = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own: list[int] = []
            for segment in self.words.segments(text or ""):
                if isinstance(segment, int):
                    extra[i] += 1
                    continue
                first, *rest = pieces(segment)
                own.append(self.index[first])
                own.extend(map(self.index.__getitem__, map(" ".__add__, rest)))
            numbers.append(np.array(own, np.int64))
        self._learn()
        return extra + np.array([self.known[own].sum() for own in numbers], np.int64)


class _Numbering(dict):
    """Numbers new keys in the order they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


@lru_cache(maxsize=1)
def _counter(content: bytes) -> TokenCounter:
    return TokenCounter(content)


def token_counts(docs: DataFrame, content: bytes, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    ``content`` is the JSON of a byte-level BPE tokenizer.  A null text is the empty text
    (0 bytes, 0 tokens); special strings inside texts are one token each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)  # one vocabulary file

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            for start, end, texts in text_slices(batch):
                rows = batch.slice(start, end - start)
                tokens = counter.count(texts)
                n_bytes = pc.fill_null(pc.binary_length(rows.column("text")).cast(pa.int64()), 0)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), n_bytes, pa.array(tokens), pa.array(tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return ids_and_texts(docs).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary_file(VOCABULARY))
