"""Counting, encoding and decoding against the tokenizers library."""

import hashlib
import itertools
import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from centroidal.llm.streaming_bpe import Codec, Decoder, Merger, bpe_round_trips, sufficient_lookahead
from centroidal.llm.token_counts import VOCABULARY, TokenCounter, token_counts
from centroidal.llm.tokenizer import Vocabulary, vocabulary_file

CONTENT = vocabulary_file(VOCABULARY)
LIBRARY = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
COUNTER = TokenCounter(CONTENT, known_pieces=200)

TEXTS = [
    None,
    "",
    " ",
    "  \n\t ",
    "a",
    "one  two   three\n four   five　",
    "it's we'll I'd'd they've 'tis O'RE",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40,
    "=" * 700 + " " * 900 + "\n" * 300 + "x",
    "naïve café — 漢字かな 한국어 עברית 🙂🏽‍♀️ é",
    "<|endoftext|>a<|endoftext|><|endoftext|> b <|endo",
    "1234567890 3.14 1,000,000 ²³ Ⅳ",
    "\x1c\x1d\x85᠎​ x\x00y",
]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts_of_odd_texts():
    assert COUNTER.count(TEXTS).tolist() == [len(ids_of(t)) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aestrnl<|>"), st.characters(exclude_categories=["Cs", "Cn", "Co"]))), max_size=6))
def test_counts_of_any_text(texts):
    assert COUNTER.count(texts).tolist() == [len(ids_of(t)) for t in texts]


def test_counts_of_long_words():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgethioansr", k=k)) for k in (50, 500, 5000, 20_000)]
    assert COUNTER.count(texts).tolist() == [len(ids_of(t)) for t in texts]


def test_counts_table(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 7), (3, "again", "y", 8), (3, "again", "y", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, over_limit int")
    found = sorted(map(tuple, token_counts(docs, CONTENT, limit=50).collect()), key=repr)
    wanted = [(i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 50) for i, t, *_ in rows]
    assert found == sorted(wanted, key=repr)
    assert token_counts(docs.limit(0), CONTENT).collect() == []


CODEC = Codec(CONTENT, known_pieces=100)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def wanted_digests(text):
    ids = ids_of(text)
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(decoded.encode())


@pytest.mark.parametrize("text", TEXTS)
def test_digests_of_odd_texts(text):
    assert CODEC.digests(text) == wanted_digests(text)


def streamed(codec, text, sizes):
    encoder, out, at = codec.encoder(), [], 0
    while at < len(text):
        size = next(sizes)
        out += encoder.feed(text[at : at + size])
        at += size
    return out + encoder.finish()


MIXED = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aestrnl<|>end"), st.characters(exclude_categories=["Cs", "Cn", "Co"])))


@settings(max_examples=300, deadline=None)
@given(MIXED, st.lists(st.integers(1, 9), min_size=1, max_size=9))
def test_chunks_do_not_matter(text, sizes):
    assert streamed(CODEC, text, itertools.cycle(sizes)) == ids_of(text)
    assert CODEC.digests(text) == wanted_digests(text)


@pytest.mark.parametrize("letters", ["ab", "aeinorst", "abcdefghijklmnopqrstuvwxyz", "-=", "é漢字", "01"])
def test_endless_words_stream(letters):
    """Tokens leave while the word goes on, and the window stays small."""
    rng = random.Random(3)
    text = "x " + "".join(rng.choices(letters, k=30_000)) + " y\n"
    encoder, out, most = CODEC.encoder(), [], 0
    for at in range(0, len(text), 100):
        out += encoder.feed(text[at : at + 100])
        most = max(most, len(encoder.open) + len(encoder.text))
    assert len(out) > 1000 and most < 3 * encoder.window
    assert out + encoder.finish() == ids_of(text)


UNITS = ["a", "7", "=", " ", "\n", "　", "ab'll ", "'s", "<|endoftext|>", "<|end", "é漢", "word ", " x", "!!'"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(UNITS), st.sampled_from([1, 2, 3, 700, 2500])), max_size=8), st.integers(0, 10**6))
def test_long_runs_next_to_one_another(parts, seed):
    """Runs longer than the window, special strings after them, cut anywhere."""
    rng = random.Random(seed)
    text = "".join(unit * times for unit, times in parts)
    sizes = iter(lambda: rng.choice([1, 17, 300, 2000]), None)
    assert streamed(CODEC, text, sizes) == ids_of(text)


@pytest.mark.parametrize("unit", ["a", " ", "\n ", "0", "=", "word ", "<|endoftext|>", "ab1"])
def test_memory_does_not_grow_with_the_text(unit):
    """The peak while a text of 40 chunks is encoded and its ids are decoded is that of a few chunks."""
    codec = Codec(CONTENT, known_pieces=100)
    chunk = unit * (10_000 // len(unit))

    def peak(chunks):
        encoder, decoder, back = codec.encoder(), Decoder(codec.words), 0
        tracemalloc.start()
        for i in range(chunks + 1):
            ids = encoder.feed(chunk) if i < chunks else encoder.finish()
            back += len(decoder.feed(ids, last=i == chunks))
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert back == chunks * len(chunk)
        return found

    peak(2)
    assert peak(40) < 1.5 * peak(4) + 100_000


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_lookahead_of_random_merge_lists(seed):
    """Tokens before the lookahead do not depend on what follows."""
    rng = random.Random(seed)
    tokens, merges, spelled = {i: bytes([97 + i]) for i in range(3)}, [], {bytes([97 + i]) for i in range(3)}
    for _ in range(40):
        a, b = rng.choice(list(tokens)), rng.choice(list(tokens))
        if tokens[a] + tokens[b] not in spelled and len(tokens[a] + tokens[b]) < 7:
            spelled.add(tokens[a] + tokens[b])
            merges.append((a, b, len(tokens)))
            tokens[len(tokens)] = tokens[a] + tokens[b]
    words = Vocabulary([0] * 97 + [0, 1, 2] + [0] * 156, merges, tokens, {})
    merger, ahead = Merger(words), sufficient_lookahead(words)
    known = bytes(rng.choices(b"abc", k=120))
    outcomes = set()
    for _ in range(12):
        ids, used = [], 0
        for i in merger.encode(known + bytes(rng.choices(b"abc", k=rng.randrange(0, 9)))):
            used += len(tokens[i])
            if used > len(known) - ahead:
                break
            ids.append(i)
        outcomes.add(tuple(ids))
    assert len(outcomes) == 1


def test_round_trip_table(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "no id", 7), (3, "again", 8), (3, "again", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    found = sorted(map(tuple, bpe_round_trips(docs, CONTENT).collect()), key=repr)
    assert found == sorted([(i, *wanted_digests(t)) for i, t, _ in rows], key=repr)
    assert bpe_round_trips(docs.limit(0), CONTENT).collect() == []
