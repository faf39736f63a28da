"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER bytes is counted from a bounded sample
and then frozen.  A byte is coded in the longest context known to the language; a byte that
was not seen there escapes, at the cost of the escape probability (method C, with exclusion
of the bytes already ruled out), to the next shorter context, and at last to all 256 bytes.
The language that gives a text the shortest code is predicted.

As the statistics are frozen, the cost of a byte depends on the last ORDER bytes only.  All
contexts of all languages form one automaton, whose states carry the exact cost of every
byte in every language.  Long texts are cut into segments that read a few bytes more at
their start, and all segments of a batch step through the automaton together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from centroidal.llm.common import ASCII_LOWER, documents, remainder, text_slices

FOLDS, HELD_OUT = 5, 0
ORDER = 4
SAMPLE_BYTES = 80_000  # of each language
SAMPLE_ROWS = 400  # most rows of a language to choose them from
LONGEST_SAMPLE = 20_000  # bytes of a text to learn from
LEAST_COUNT = 2  # of a context
SEGMENT = 512
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


class ContextTrees:
    """The automaton of the context trees of several languages."""

    def __init__(self, samples: dict[str, bytes], order: int = ORDER):
        self.languages = sorted(samples)
        self.order = order
        texts = [np.frombuffer(samples[name].translate(ASCII_LOWER), np.uint8) for name in self.languages]
        seen = np.unique(np.concatenate([np.zeros(0, np.uint8), *texts]))
        self.symbols = len(seen) + 1  # 0 stands for every byte that was not seen
        self.symbol_of = np.zeros(256, np.uint8)
        self.symbol_of[seen] = np.arange(1, self.symbols)
        coded = [self.symbol_of[t].astype(np.int64) for t in texts]
        self._states([[self._grams(s, k) for k in range(order + 1)] for s in coded])

    def _grams(self, symbols: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of all runs of ``context`` symbols and the one after them."""
        n = max(0, len(symbols) - context)
        key = np.zeros(n, np.int64)
        for i in range(context + 1):
            key = key * self.symbols + symbols[i : i + n]
        return np.unique(key, return_counts=True)

    def _states(self, grams: list[list[tuple[np.ndarray, np.ndarray]]]) -> None:
        size = self.symbols
        levels = [np.zeros(1, np.int64)]
        for k in range(1, self.order + 1):
            # A context of k symbols is a gram of k - 1 symbols and one more.
            often = [keys[counts >= LEAST_COUNT] for keys, counts in (g[k - 1] for g in grams)]
            levels.append(np.unique(np.concatenate([np.zeros(0, np.int64), *often])))
        first = np.cumsum([0, *map(len, levels)])
        states = int(first[-1])
        self.next = np.zeros((states, size), np.int32)
        counts = np.zeros((len(grams), states, size), np.float32)
        suffix = np.zeros(states, np.int64)
        level_of = np.repeat(np.arange(self.order + 1), list(map(len, levels)))
        for k, keys in enumerate(levels):
            own = np.arange(first[k], first[k + 1])
            if k:
                suffix[own] = first[k - 1] + np.searchsorted(levels[k - 1], keys % size ** (k - 1))
                self.next[own] = self.next[suffix[own]]
            if k < self.order:
                deeper = levels[k + 1]
                at = np.searchsorted(keys, deeper // size)
                known = (at < len(keys)) & (keys[np.minimum(at, max(len(keys) - 1, 0))] == deeper // size)
                self.next[own[at[known]], deeper[known] % size] = first[k + 1] + np.flatnonzero(known)
            for language, own_grams in enumerate(grams):
                gram, count = own_grams[k]
                at = np.minimum(np.searchsorted(keys, gram // size), max(len(keys) - 1, 0))
                known = keys[at] == gram // size if len(keys) else np.zeros(len(gram), bool)
                counts[language, own[at[known]], gram[known] % size] = count[known]
        self.cost = np.stack([self._costs(c, suffix, level_of) for c in counts], axis=-1) if len(grams) else None

    def _costs(self, counts: np.ndarray, suffix: np.ndarray, level_of: np.ndarray) -> np.ndarray:
        """Bits of every symbol in every state, for one language."""
        cost = np.zeros(counts.shape, np.float32)
        for k in range(self.order + 1):
            own = np.flatnonzero(level_of == k)
            for rows in np.array_split(own, max(1, len(own) // 4096)):
                at, ruled_out = rows, np.zeros((len(rows), self.symbols), bool)
                escaped = np.zeros(len(rows))
                for _ in range(k + 1):
                    left = np.where(ruled_out, 0, counts[at])
                    total, kinds = left.sum(axis=1), (left > 0).sum(axis=1)
                    known = total > 0
                    scale = np.where(known, total + kinds, 1)
                    bits = escaped[:, None] - np.log2(np.where(left > 0, left, 1) / scale[:, None])
                    cost[rows] = np.where(left > 0, bits, cost[rows])
                    escaped = escaped - np.log2(np.where(known, kinds, 1) / scale)
                    ruled_out |= left > 0
                    at = suffix[at]
                unseen = escaped + np.log2(np.maximum(1, 256 - ruled_out.sum(axis=1)))
                cost[rows] = np.where(ruled_out, cost[rows], unseen[:, None])
        return cost

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        result = np.zeros((len(texts), len(self.languages)))
        symbols = self.symbol_of[np.frombuffer(b"".join(texts).translate(ASCII_LOWER), np.uint8)]
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        if not len(owner):
            return result
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text_start = (np.cumsum(lengths) - lengths)[owner]
        start = nth * SEGMENT
        end = np.minimum(start + SEGMENT, lengths[owner])
        warm = np.minimum(start, self.order)
        by_length = np.argsort(-(end - start + warm), kind="stable")
        at = (text_start + start - warm)[by_length]
        steps, warm = (end - start + warm)[by_length], warm[by_length]
        state = np.zeros(len(owner), np.int64)
        bits = np.zeros((len(owner), len(self.languages)))
        following, costs = self.next.ravel(), self.cost.reshape(-1, len(self.languages))
        for step in range(int(steps[0])):
            n = int(np.searchsorted(-steps, -step))  # segments that go on
            cell = state[:n] * self.symbols + symbols[at[:n] + step]
            price = costs[cell]
            if step < self.order:
                price = np.where((step >= warm[:n])[:, None], price, 0)
            bits[:n] += price
            state[:n] = following[cell]
        np.add.at(result, owner, bits[np.argsort(by_length, kind="stable")])
        return result


def sample(docs: DataFrame) -> dict[str, bytes]:
    """Training text by language: at most SAMPLE_BYTES and one text more of each.

    Rows are drawn by a hash of id and text.  The table's number of languages is small.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).filter(
        F.col("lang").isNotNull()
        & F.col("text").rlike(r"\p{L}")
        & (F.octet_length("text") <= LONGEST_SAMPLE)
        & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    held = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 30))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    drawn = (
        rows.join(F.broadcast(held), "lang")  # one row for each language
        .withColumn("draw", draw)
        .filter(F.col("draw") * F.col("rows") <= 2.0 * SAMPLE_ROWS * (1 << 30))
        .withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= SAMPLE_ROWS)
        .select("lang", "nth", "text")
        .collect()
    )
    samples: dict[str, list[bytes]] = {}
    for row in sorted(drawn, key=lambda r: (r["lang"], r["nth"])):
        texts = samples.setdefault(row["lang"], [])
        if sum(map(len, texts)) < SAMPLE_BYTES and (text := row["text"].encode()) not in texts:
            texts.append(text)
    return {name: b"\n".join(texts) for name, texts in samples.items()}


@lru_cache(maxsize=1)
def _trees(samples: tuple[tuple[str, bytes], ...]) -> ContextTrees:
    return ContextTrees(dict(samples))


def predict(trees: ContextTrees | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and its share of the probability, for equally likely languages."""
    if trees is None or not trees.languages:
        return [(UNKNOWN, 0.0)] * len(texts)
    lengths = trees.code_lengths([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    out = []
    for text, bits in zip(texts, lengths.tolist()):
        if not text or not _LETTER.search(text):
            out.append((UNKNOWN, 0.0))
            continue
        least = min(bits)
        share = 1 / math.fsum(2.0 ** max(least - b, -1000.0) for b in bits)
        out.append((trees.languages[bits.index(least)], share))
    return out


def language_id(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if
    nothing was learned.  Equal code lengths go to the first language in alphabetical order.
    """
    learned = tuple(sorted(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(learned) if learned else None
        for batch in batches:
            for start, end, texts in text_slices(batch):
                names, scores = zip(*predict(trees, texts))
                rows = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    held_out = (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return docs.select(doc_id, held_out, F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double"
    )


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id(docs, sample(docs))
