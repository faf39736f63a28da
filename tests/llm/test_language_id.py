"""Exact code lengths, held-out accuracy and edge cases of the language identifier."""

import math
import random
from collections import Counter

import pytest

from centroidal.llm import language_id as lang
from centroidal.llm.common import documents

SF_DIR = "/root/testdata/sf0.01"


def plain_length(sample, text, order, known):
    """Method C with exclusion, walked context by context; contexts of the tree are ``known``."""
    counts = {}
    for k in range(order + 1):
        for i in range(len(sample) - k):
            counts.setdefault(sample[i : i + k], Counter())[sample[i + k]] += 1
    bits = 0.0
    for i, byte in enumerate(text):
        out, k = set(), min(i, order)
        while text[i - k : i] not in known:
            k -= 1
        while True:
            left = {b: n for b, n in counts.get(text[i - k : i], {}).items() if b not in out}
            if left:
                scale = sum(left.values()) + len(left)
                if byte in left:
                    bits -= math.log2(left[byte] / scale)
                    break
                bits -= math.log2(len(left) / scale)
                out |= set(left)
            if k == 0:
                bits += math.log2(max(1, 256 - len(out)))
                break
            k -= 1
    return bits


def test_code_lengths_are_exact():
    rng = random.Random(2)
    samples = {name: bytes(rng.choices(alphabet, k=400)) for name, alphabet in (("a", b"abc de"), ("b", b"abd fg"), ("c", b"xyz"))}
    texts = [bytes(rng.choices(b"abcdefgxyz !", k=k)) for k in (0, 1, 3, 40, 511, 512, 513, 1500)]
    trees = lang.ContextTrees(samples, order=3)
    known = {b""}
    for s in samples.values():
        for k in range(1, 4):
            runs = Counter(s[i : i + k] for i in range(len(s) - k + 1))
            known |= {c for c, n in runs.items() if n >= lang.LEAST_COUNT}
    found = trees.code_lengths(texts)
    for j, name in enumerate(trees.languages):
        for i, text in enumerate(texts):
            assert found[i, j] == pytest.approx(plain_length(samples[name], text, 3, known), rel=1e-5, abs=1e-4)


def test_held_out_accuracy(spark):
    docs = documents(spark, SF_DIR)
    found = lang.op6_language_id(spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_texts(spark):
    samples = {"en": b"the cat and the dog and the bird", "de": b"der hund und die katze und der vogel"}
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "und der"), (4, "und der"), (None, "the dog"), (5, "and the " * 20_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double")
    found = sorted(((r.doc_id, r.lang_pred) for r in lang.language_id(docs, samples).collect()), key=repr)
    wanted = [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (None, "en"), (5, "en")]
    assert found == sorted(wanted, key=repr)
    assert lang.language_id(docs.limit(0), samples).collect() == []
    assert {r.lang_pred for r in lang.language_id(docs, {}).collect()} == {"und"}


def test_sample_is_bounded_and_skips_rows_without_language(spark):
    rows = [(i, f"text {i} " * 300, "en" if i % 3 else None) for i in range(200)] + [(1, None, "fr"), (2, "9", "fr")]
    samples = lang.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert list(samples) == ["en"] and len(samples["en"]) <= lang.SAMPLE_BYTES + 2 * lang.LONGEST_SAMPLE
