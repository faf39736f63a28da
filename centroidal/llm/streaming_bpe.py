"""BPE as a streaming transducer with bounded lookahead, and its inverse.

Encoding reads text in chunks and writes token ids as soon as no later text can change
them.  Three bounds make that possible with constant memory:

* White space after another character always begins a pre-token, so what stands before the
  last such place of a chunk is decided at once.  Pieces between single spaces leave the
  transducer in its first state; what short ones gave is remembered.
* In a longer piece without such a place, the next boundary is decided with at most a few
  characters ahead.
* Inside one endless pre-token, of any characters, a token is stable once ``lookahead`` bytes
  follow it.  That number is computed from the merge list: going through the merges in rank
  order, it follows how far to the left the presence of a token can depend on what is to its
  right.  Text after a token boundary is encoded as if it stood alone, so the window restarts there.

Decoding is a state machine from token bytes to text, whose state is an unfinished
character of at most three bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from centroidal.llm.common import documents, ids_and_texts, sole_memory, text_slices
from centroidal.llm.tokenizer import PRE_TOKEN, Vocabulary, pieces, vocabulary, vocabulary_file

VOCABULARY = "byte_bpe_50k.json"
KNOWN_PIECES = 700_000  # remembered by a task; beyond it, it starts afresh
LONGEST_KNOWN = 64  # characters of a piece worth remembering
TEXT_CHUNK = 1 << 16  # characters fed at once
ID_CHUNK = 1 << 16  # ids decoded at once


def sufficient_lookahead(words: Vocabulary) -> int:
    """Bytes that must follow a token before later text can no longer change it.

    ``reach[t]`` bounds the distance from the end of the known text back to the start of a
    token t whose presence may depend on what comes next.  At first that is any token at
    the very end.  A merge (u, v) makes the presence of u, and of the token made, depend on
    v; and the token made on u.  Merges act in rank order, so one pass in that order
    follows every chain of dependencies.
    """
    length = {i: len(b) for i, b in words.token_bytes.items()}
    reach = dict(length)
    for left, right, made in words.merges:
        further = length[left] + reach[right]
        reach[left] = max(reach[left], further)
        reach[made] = max(reach[made], reach[left])
    return max(reach.values(), default=0)


class Merger:
    """Encodes one run of bytes by its merges."""

    def __init__(self, words: Vocabulary):
        self.byte_ids = words.byte_ids
        self.base = words.size
        self.rank = {a * self.base + b: r for r, (a, b, _) in enumerate(words.merges)}
        self.made = [m for _, _, m in words.merges]

    def encode(self, data: bytes) -> list[int]:
        symbols = [self.byte_ids[b] for b in data]
        return self._short(symbols) if len(symbols) <= 48 else self._long(symbols)

    def _short(self, symbols: list[int]) -> list[int]:
        never, rank, base = len(self.made), self.rank, self.base
        ranks = [rank.get(a * base + b, never) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == never:
                break
            i = ranks.index(lowest)
            symbols[i : i + 2] = [made] = [self.made[lowest]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(made * base + symbols[i + 1], never)
            if i:
                ranks[i - 1] = rank.get(symbols[i - 1] * base + made, never)
        return symbols

    def _long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        n = len(symbols)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.rank.get(symbols[i] * self.base + symbols[j])) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has gone since
            symbols[i], symbols[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s >= 0]


class Encoder:
    """Encodes one text, fed in chunks; ``feed`` and ``finish`` return the ids that are stable.

    ``push`` gives them packed.  What it keeps of the text is at most ``window`` bytes of an
    undecided piece and the start of a special string.
    """

    def __init__(self, words: Vocabulary, merger: Merger, lookahead: int, known: _Known):
        self.words, self.merger, self.lookahead, self.known = words, merger, lookahead, known.__getitem__
        self.longest_special = max(map(len, words.specials), default=1)
        self.window = 2 * lookahead + 2 * words.longest_token
        self.text = ""
        self.open: bytes = b""  # the not yet stable part of an endless pre-token
        self.kind: str | None = None  # what that pre-token goes on with

    def feed(self, chunk: str) -> list[int]:
        return _unpacked(self.push(chunk, False))

    def finish(self) -> list[int]:
        return _unpacked(self.push("", True))

    def push(self, chunk: str, last: bool) -> bytes:
        """The packed ids that have become stable."""
        self.text += chunk
        out: list[bytes] = []
        *whole, (rest, held) = self._split_specials(last)
        for part in whole:
            if isinstance(part, str):
                out.append(self._plain(part, True)[0])
                continue
            if self.kind is not None:
                out.append(self._plain("", True)[0])
            out.append(_packed([part]))
        packed, rest = self._plain(rest, last)
        self.text = rest + held
        return b"".join([*out, packed])

    def _split_specials(self, last: bool) -> list:
        """Finished parts, then the unfinished one as (text, text that may begin a special string)."""
        parts: list = self.words.segments(self.text)
        tail = parts.pop() if parts and isinstance(parts[-1], str) else ""
        held = 0
        if not last:
            ends = range(1, min(self.longest_special, len(tail) + 1))
            held = max((k for k in ends if any(s.startswith(tail[-k:]) for s in self.words.specials)), default=0)
        return [*parts, (tail[: len(tail) - held], tail[len(tail) - held :])]

    def _plain(self, text: str, last: bool) -> tuple[bytes, str]:
        """Packed ids of what is decided, and the text that is not."""
        out: list[bytes] = []
        if self.kind is not None:
            end = _RUNS[self.kind].match(text).end()
            goes_on = end == len(text) and not last
            # The last white space of a run goes with the next word, if there is one.
            taken = end - 1 if self.kind == "spaces" and not (end == len(text) and last) else end
            self.open += _utf8(text[:taken])
            text = text[taken:]
            if goes_on:
                return self._stable(), text
            out.append(_packed(self.merger.encode(self.open)))
            self.open, self.kind = b"", None
        if last:
            return b"".join([*out, self._closed(text)]), ""
        # White space after another character begins a pre-token, whatever comes next.
        if found := _BOUNDARY.search(text):
            out.append(self._closed(text[: found.start()]))
            text = text[found.start() :]
        if len(text) > self.window:
            packed, text = self._endless(text)
            out.append(packed)
        return b"".join(out), text

    def _closed(self, text: str) -> bytes:
        """All ids of a text at whose ends pre-tokens end."""
        if not text:
            return b""
        lead = " " if text[0] == " " and not text[1:2].isspace() else ""
        first, *others = pieces(text[len(lead) :])
        return self.known(lead + first) + b"".join(map(self.known, map(" ".__add__, others)))

    def _endless(self, text: str) -> tuple[bytes, str]:
        """The same for a long piece: whole pre-tokens, then the stable part of one that goes on."""
        out: list[bytes] = []
        at = 0
        while at < len(text):
            end = PRE_TOKEN.match(text, at).end()
            # What follows may still move the boundary: a run goes on, a contraction completes,
            # or the last white space goes with the next word.
            if end + 3 < len(text):
                out.append(self.known(text[at:end]))
                at = end
                continue
            kind = _kind(text, at, end)
            if kind is None or end - at <= self.window:
                break
            run = len(text) if kind == "spaces" else end
            if run < len(text):  # the run has ended, as others can only go on at the end of the text
                out.append(self.known(text[at:end]))
                at = end
                continue
            self.kind = kind
            taken = run - 1 if kind == "spaces" else run
            self.open = _utf8(text[at:taken])
            out.append(self._stable())
            at = taken
            break
        return b"".join(out), text[at:]

    def _stable(self) -> bytes:
        """Emit the tokens that end ``lookahead`` bytes before the end of the window."""
        out: list[int] = []
        if len(self.open) > self.window:
            ids = self.merger.encode(self.open)
            used = 0
            for i in ids:
                size = len(self.words.token_bytes[i])
                if used + size > len(self.open) - self.lookahead:
                    break
                out.append(i)
                used += size
            self.open = self.open[used:]
        return _packed(out)


_BOUNDARY = regex.compile(r"(?r)(?<=\P{White_Space})\p{White_Space}")  # the last one
_RUNS = {
    "letters": regex.compile(r"\p{L}*"),
    "numbers": regex.compile(r"\p{N}*"),
    "others": regex.compile(r"[^\p{White_Space}\p{L}\p{N}]*"),
    "spaces": regex.compile(r"\p{White_Space}*"),
}


def _kind(text: str, start: int, end: int) -> str | None:
    """The class of characters with which a pre-token can go on at the end of the text.

    A run of white space is one pre-token but for its last character, so that one is held
    back while the run goes on.
    """
    if _RUNS["spaces"].match(text, start).end() == len(text):
        return "spaces"
    return next((k for k, run in _RUNS.items() if k != "spaces" and run.match(text, end - 1).end() == end), None)


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Decoder:
    """From ids, fed in chunks, to text; an unfinished character waits for its other bytes."""

    def __init__(self, words: Vocabulary):
        self.token_bytes = words.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.token_bytes.__getitem__, ids)), last)


class Codec:
    """Both directions for many texts; the encoders share what closed pieces are known to give."""

    def __init__(self, content: bytes, known_pieces: int = KNOWN_PIECES):
        self.words = vocabulary(content)
        self.merger = Merger(self.words)
        self.lookahead = sufficient_lookahead(self.words)
        self.known = _Known(self.merger, known_pieces)

    def encoder(self) -> Encoder:
        return Encoder(self.words, self.merger, self.lookahead, self.known)

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, as little-endian unsigned 32-bit integers, chunk by chunk."""
        encoder = self.encoder()
        for start in range(0, len(text), TEXT_CHUNK):
            yield encoder.push(text[start : start + TEXT_CHUNK], start + TEXT_CHUNK >= len(text))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """The number of ids, and the digests of the ids and of the text decoded from them."""
        ids_hash, text_hash, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(self.words), 0
        for packed in self.encode(text or ""):
            ids_hash.update(packed)
            n += len(packed) // 4
            for start in range(0, len(packed), 4 * ID_CHUNK):
                ids = np.frombuffer(packed, "<u4", min(ID_CHUNK, (len(packed) - start) // 4), start)
                text_hash.update(decoder.feed(ids.tolist()).encode())
        text_hash.update(decoder.feed([], last=True).encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


class _Known(dict):
    """Packed ids of closed pieces: after one the encoder is in its first state. Emptied when full."""

    def __init__(self, merger: Merger, most: int):
        self.merger, self.most = merger, most

    def __missing__(self, piece: str) -> bytes:
        packed = b"".join(_packed(self.merger.encode(_utf8(token[0]))) for token in PRE_TOKEN.finditer(piece))
        if len(piece) <= LONGEST_KNOWN:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _unpacked(packed: bytes) -> list[int]:
    return [i for (i,) in struct.iter_unpack("<I", packed)]


@lru_cache(maxsize=1)
def _codec(content: bytes) -> Codec:
    return Codec(content)


def bpe_round_trips(docs: DataFrame, content: bytes) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per row of ``docs``.

    A null text is the empty text.  Special strings inside texts become their special ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("streaming_bpe", _codec.cache_clear)
        codec = _codec(shared.value)
        for batch in batches:
            for start, end, texts in text_slices(batch):
                n, ids, decoded = zip(*map(codec.digests, texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, end - start), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return ids_and_texts(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_round_trips(documents(spark, sf_dir), vocabulary_file(VOCABULARY))
