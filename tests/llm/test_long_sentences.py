"""Repeated passages of few sentences, of none of their own, and of other scripts."""

import random

import pytest

from centroidal.llm import substring_dedup as dedup

RNG = random.Random(5)
SOUNDS = ["ka", "mo", "ti", "lu", "re", "so", "ne", "pa"]


def words(n):
    return " ".join("".join(RNG.choices(SOUNDS, k=3)) for _ in range(n))


def letters(n):
    return "".join(chr(RNG.randrange(0x4E00, 0x9000)) for _ in range(n))


@pytest.mark.parametrize(
    "first, second, passage",
    [
        (f"{words(9)} %s {words(9)}", f"{words(7)} %s {words(11)}", words(60)),
        (f"{words(9)}.\n%s\n{words(9)}", f"{words(7)}!\n%s\n{words(11)}", f"{words(40)}, {words(20)}."),
        (f"{letters(9)}%s{letters(9)}", f"{letters(7)}%s{letters(12)}", letters(90)),
        (f"{letters(9)}。%s{letters(9)}", f"{letters(7)}。%s{letters(12)}", "。".join(letters(8) for _ in range(12)) + "。"),
    ],
)
def test_passages_without_three_sentences(spark, first, second, passage):
    docs = spark.createDataFrame([(1, first % passage), (2, second % passage)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in dedup.deduplicated(docs).collect()}
    assert found[1].n_removed == 0 and found[1].text == first % passage
    gone = len(second % passage) - len(found[2].text)
    assert 0.6 * len(passage) <= gone <= len(passage) + 1  # a line end goes with its sentence
    own = second.split("%s")
    assert found[2].text.startswith(own[0]) and found[2].text.endswith(own[1])


def test_pieces_join_to_the_text():
    for text in (f"  {words(40)} \n\t{words(30)}; {letters(50)} x", " " * 50, " " * 9 + words(20)):
        assert "".join(dedup.sentences(text)) == text
