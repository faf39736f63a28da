"""Language-model scores from Elias-Fano n-gram tries.

The model interpolates trigrams with bigrams and those with the smoothed word frequencies:
P(w | v) = (c(v w) + K P(w)) / (c(v) + K), and P(w | u v) = (c(u v w) + K P(w | v)) / (c(u v) + K).
The shares c(v w) / (c(v) + K) and c(u v w) / (c(u v) + K) and the back-off weights
K / (c(u v) + K) are quantised to one byte on a logarithmic scale; K / (c(v) + K) and P(w)
follow from the exact counts of v and w.  Counts cover all training texts: nothing is pruned.
A text begins with a mark that is a context but no token; its first token has no trigram.

The model is as large as the corpus makes it, so it is never in one place.  It is cut into
shards by the first word; a word with more occurrences than a shard should hold is cut
further by the second.  Trigrams lie where their first two words lie, so a shard is a whole
trie.  Each block of texts sends every shard its distinct words, bigrams and trigrams, with
their counts in training texts (see ``blocks``).  The shard adds the counts up, builds its
trie, and answers with the count of every word, the code and back-off weight of every bigram
and the code of every trigram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.llm.blocks import answered, block_rows, dealt, letters_of, partitions_of, read_back, text_bytes
from centroidal.llm.common import ASCII_LOWER, documents, ids_and_texts, remainder, text_slices, written
from centroidal.llm.elias_fano import Level, Trie

FOLDS, HELD_OUT = 5, 1
K = 4.0
SHARD_BYTES = 8_000_000  # of text for a shard of the model
KNOWN_WORDS = 400_000
START, END = 1, 2  # stand for the places before and after a text
WORD_BITS, THIRD_BITS = 32, 24  # of a second and a third word's hash; fewer words follow a pair than a word
STEP = 9.5 / 254  # of log10 between two codes; code 255 is 1


class _Hashes(dict):
    """Hash of each word, with a bound on how many are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hash = _Hashes().__getitem__


def words(text: str | None) -> np.ndarray:
    """Hashes of the words of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    return np.fromiter(map(_hash, found), np.uint64, len(found))


def quantised(share: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(255 + np.log10(share) / STEP), 1, 255).astype(np.uint8)


SHARES = np.r_[0.0, 10.0 ** ((np.arange(1, 256) - 255) * STEP)]


def counted(docs: DataFrame) -> DataFrame:
    """``(hash, n)``: training tokens; START stands for the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_slices(batch):
                marks = np.repeat(np.array([START, END], np.uint64), len(texts))
                hashes, n = np.unique(np.concatenate([marks, *map(words, texts)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], ["hash", "n"])

    training = ids_and_texts(docs).filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    return training.mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def _bytes(parts: list[np.ndarray]) -> bytes:
    return b"".join(p.tobytes() for p in parts)


def _small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts in one byte each, followed by those that need more."""
    large = counts >= 255
    return [np.minimum(counts, 255).astype(np.uint8), counts[large].astype(np.int64)]


class _Block:
    """A block's tokens, its distinct words, bigrams and trigrams, and their shards."""

    def __init__(self, rows: pa.Table, shards: int, hot: np.ndarray):
        self.order, self.ids, texts = block_rows(rows)
        held_out = rows.column("held_out").to_pylist()
        self.held_out = np.array([held_out[i] for i in self.order], bool)
        hashes = [words(t) for t in texts]
        self.sizes = np.array([len(h) + 1 for h in hashes], np.int64)
        start, stop = np.array([START], np.uint64), np.array([END], np.uint64)
        number, kinds = pd.factorize(np.concatenate([x for h in hashes for x in (start, h, stop)]))
        # Words are numbered by home shard, and in it by hash.
        by_home = np.lexsort((kinds, kinds % np.uint64(shards)))
        self.words = kinds[by_home]
        n = len(self.words)
        home = (self.words % np.uint64(shards)).astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[by_home] = np.arange(n)
        line = rank[number]
        begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        is_token = np.ones(len(line), bool)
        is_token[begins] = False
        at = np.flatnonzero(is_token)
        self.token, self.before = line[at], line[at - 1]
        trained = np.repeat(~self.held_out, self.sizes)
        self.counts = np.bincount(self.token[trained], minlength=n)
        self.counts[line[begins[0]]] = (~self.held_out).sum()

        keys, self.pair = np.unique(self.before * n + self.token, return_inverse=True)
        self.context, following = keys // n, keys % n
        shard = home[self.context]
        split = np.flatnonzero(np.isin(self.words[self.context], hot))
        mixed = self.words[self.context[split]] ^ (self.words[following[split]] >> np.uint64(64 - WORD_BITS)) * np.uint64(0x9E3779B97F4A7C15)
        shard[split] = (mixed % np.uint64(shards)).astype(np.int64)
        pairs = np.argsort(shard, kind="stable")
        moved = np.empty(len(pairs), np.int64)
        moved[pairs] = np.arange(len(pairs))
        self.pair = moved[self.pair]  # bigrams are in the order of their shards from here
        self.context, self.shard = self.context[pairs], shard[pairs]
        self.after = self.words[following[pairs]] >> np.uint64(64 - WORD_BITS)
        self.pair_counts = np.bincount(self.pair[trained], minlength=len(pairs))

        # A trigram is a bigram's place and the next word; the first token of a text has none.
        self.has_two = np.ones(len(at), bool)
        self.has_two[begins - np.arange(len(begins))] = False
        third = np.flatnonzero(self.has_two)
        keys, self.triple = np.unique(self.pair[third - 1] * n + self.token[third], return_inverse=True)
        owner = keys // n
        self.third = (self.words[keys % n] >> np.uint64(64 - THIRD_BITS)).astype(np.uint32)
        self.triple_counts = np.bincount(self.triple[trained[third]], minlength=len(keys))
        self.thirds = np.bincount(owner, minlength=len(pairs))
        self.third_ends = np.r_[0, np.cumsum(self.thirds)]

        # Heads: every word in its home shard, and every context wherever it has bigrams.
        self.heads = np.unique(np.r_[home * n + np.arange(n), self.shard * n + self.context])
        self.at_home = home[self.heads % n] == self.heads // n
        self.following = np.bincount(np.searchsorted(self.heads, self.shard * n + self.context), minlength=len(self.heads))
        self.n, self.shards = n, shards

    def of_shard(self, shard: int) -> tuple[slice, slice, slice]:
        """Its heads, bigrams and trigrams."""
        heads = np.searchsorted(self.heads, [shard * self.n, (shard + 1) * self.n]).tolist()
        pairs = np.searchsorted(self.shard, [shard, shard + 1])
        return slice(*heads), slice(*pairs.tolist()), slice(*self.third_ends[pairs].tolist())

    def letters(self) -> Iterator[tuple[int, bytes]]:
        word = self.heads % self.n
        counts = np.where(self.at_home, self.counts[word], 0)
        for shard in np.unique(self.heads // self.n).tolist():
            heads, pairs, triples = self.of_shard(shard)
            parts = [
                np.array([x.stop - x.start for x in (heads, pairs, triples)], np.int64),
                self.words[word[heads]],
                self.after[pairs].astype(np.uint32),
                self.third[triples].view(np.uint8).reshape(-1, 4)[:, : THIRD_BITS // 8],
            ]
            small = []
            for some in (counts[heads], self.following[heads], self.pair_counts[pairs], self.thirds[pairs], self.triple_counts[triples]):
                small += _small(some)
            yield shard, _bytes(parts) + zstandard.compress(_bytes(small), 1)


class _Letter:
    def __init__(self, data: bytes):
        heads, pairs, triples = np.frombuffer(data, np.int64, 3).tolist()
        at = 24

        def read(kind, n):
            nonlocal at  # ``data`` too is what it is at the time
            part = np.frombuffer(data, kind, n, at)
            at += part.nbytes
            return part

        def read_counts(n):
            counts = read(np.uint8, n).astype(np.int64)
            large = np.flatnonzero(counts == 255)
            counts[large] = read(np.int64, len(large))
            return counts

        self.head, self.after = read(np.uint64, heads), read(np.uint32, pairs)
        third = np.zeros((triples, 4), np.uint8)
        third[:, : THIRD_BITS // 8] = read(np.uint8, triples * (THIRD_BITS // 8)).reshape(triples, THIRD_BITS // 8)
        self.third = third.view(np.uint32).ravel()
        data, at = zstandard.decompress(data[at:]), 0
        self.count, self.following = read_counts(heads), read_counts(heads)
        self.pair_count, self.thirds, self.triple_count = read_counts(pairs), read_counts(pairs), read_counts(triples)


class _Asked:
    """The distinct (context, word) that the letters of a shard ask for, in order."""

    def __init__(self, owner: np.ndarray, words: np.ndarray, seen: np.ndarray, bits: int):
        keys, self.inverse = np.unique(owner.astype(np.uint64) << np.uint64(bits) | words, return_inverse=True)
        self.owner, self.words = (keys >> np.uint64(bits)).astype(np.int64), keys & np.uint64((1 << bits) - 1)
        self.seen = np.bincount(self.inverse, seen, len(keys)).astype(np.int64)

    def level(self, context_counts: np.ndarray, k: float) -> tuple[Level, np.ndarray]:
        """A level of those seen in training, and their counts."""
        kept = np.flatnonzero(self.seen)
        owner, counts = self.owner[kept], self.seen[kept]
        return Level(len(context_counts), owner, self.words[kept], quantised(counts / (context_counts[owner] + k))), counts

    def places(self, level: Level) -> np.ndarray:
        return level.find(self.owner, self.words)[self.inverse]


def _shard_answers(letters: list[bytes], hot: np.ndarray, hot_counts: np.ndarray, k: float) -> list[bytes]:
    """Counts of the words, codes and back-off weights of the bigrams, codes of the trigrams of each letter."""
    read = [_Letter(x) for x in letters]

    def joined(name: str) -> np.ndarray:
        return np.concatenate([getattr(x, name) for x in read])

    def cuts(name: str) -> np.ndarray:
        return np.cumsum([len(getattr(x, name)) for x in read])[:-1]

    heads, place = np.unique(joined("head"), return_inverse=True)
    counts = np.bincount(place, joined("count"), len(heads)).astype(np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, heads), len(hot) - 1)
        counts = np.where(hot[at] == heads, hot_counts[at], counts)

    asked = _Asked(np.repeat(place, joined("following")), joined("after"), joined("pair_count"), WORD_BITS)
    pairs, pair_counts = asked.level(counts, k)
    places = asked.places(pairs)
    del asked

    # A trigram can have been seen only if its first two words were.
    owner = np.repeat(places, joined("thirds"))
    possible = np.flatnonzero(owner >= 0)
    asked = _Asked(owner[possible], joined("third")[possible], joined("triple_count")[possible], THIRD_BITS)
    triples, _ = asked.level(pair_counts, k)
    triple_codes = np.zeros(len(owner), np.uint8)
    triple_codes[possible] = triples.code(asked.places(triples))
    del asked, owner, possible

    weights = np.full(len(places), 255, np.uint8)
    known = places >= 0
    weights[known] = quantised(k / (pair_counts + k))[places[known]]
    trie = Trie(heads, pairs, triples)
    by_letter = zip(
        np.split(counts[trie.context(heads)][place], cuts("head")),
        *(np.split(x, cuts("after")) for x in (trie.pairs.code(places), weights)),
        np.split(triple_codes, cuts("third")),
    )
    return [zstandard.compress(_bytes(parts), 1) for parts in by_letter]


def scores(docs: DataFrame, k: float = K) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    One row per row of ``docs``.  Null and empty texts are one token, the end.  Repeated rows
    count each time.  Where nothing is learned, every token scores as the only unknown word.
    """
    plain = ids_and_texts(docs).withColumn("held_out", remainder(F.col("doc_id"), FOLDS) == HELD_OUT)
    total = text_bytes(plain)
    shards = max(partitions_of(docs), -(-total // SHARD_BYTES))
    tokens = written(counted(docs), "word-counts")
    texts = (tokens.filter(F.col("hash") == START).first() or {"n": 0})["n"]
    sums = tokens.filter(F.col("hash") != START).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    n, kinds = sums["n"] or 0, sums["kinds"]
    # More than a shard's share: fewer words than shards, so the list is bounded.
    most = max(1.0, (n + texts) / shards)
    often = sorted((r["hash"] & (1 << 64) - 1, r["n"]) for r in tokens.filter(F.col("n") > most).collect())
    hot, hot_counts = np.array([h for h, _ in often], np.uint64), np.array([c for _, c in often], np.int64)
    by_block = dealt(plain, total)

    def write(block: int, rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        return _Block(rows, shards, hot).letters()

    def answer(blocks: list[int], letters: list[bytes]) -> list[bytes]:
        return _shard_answers(letters, hot, hot_counts, k)

    def read(block: int, rows: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        own = _Block(rows, shards, hot)
        counts = np.zeros(own.n, np.int64)
        pair_codes, weights = np.zeros(len(own.context), np.uint8), np.full(len(own.context), 255, np.uint8)
        triple_codes = np.zeros(len(own.third), np.uint8)
        for shard, reply in answers.items():
            reply = zstandard.decompress(reply)
            heads, pairs, triples = own.of_shard(shard)
            size, two, three = (x.stop - x.start for x in (heads, pairs, triples))
            counts[(own.heads % own.n)[heads]] = np.frombuffer(reply, np.int64, size)
            codes = np.frombuffer(reply, np.uint8, 2 * two + three, 8 * size)
            pair_codes[pairs], weights[pairs], triple_codes[triples] = np.split(codes, [two, 2 * two])
        single = (counts + 0.5) / (n + 0.5 * (kinds + 1))
        token = own.token
        shares = SHARES[pair_codes[own.pair]] + k / (counts[own.before] + k) * single[token]
        third = np.flatnonzero(own.has_two)
        weight = SHARES[weights[own.pair[third - 1]]]
        shares[third] = SHARES[triple_codes[own.triple]] + weight * np.minimum(shares[third], 1.0)
        starts = np.cumsum(own.sizes) - own.sizes
        columns = {
            "doc_id": pa.array(own.ids, pa.int64()),
            "held_out": pa.array(own.held_out),
            "n_tokens": pa.array(own.sizes),
            "n_known": pa.array(np.add.reduceat((counts[token] > 0).astype(np.int64), starts)),
            "train_tokens": pa.array([n] * len(own.ids), pa.int64()),
            "base_score": pa.array(np.add.reduceat(np.log10(single)[token], starts)),
            "score": pa.array(np.add.reduceat(np.log10(np.minimum(shares, 1.0)), starts)),
        }
        return pa.table(columns)

    replies = answered(letters_of(by_block, write), answer, shards)
    return read_back(
        by_block,
        replies,
        read,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
