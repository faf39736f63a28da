"""Held-out accuracy and edge cases of the compression-distance classifier."""

import pytest

from centroidal.llm import toxicity as tox
from centroidal.llm.common import documents, table
from centroidal.llm.toxicity import op9_toxicity

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return tox.fit(tox.sample(documents(spark, SF_DIR), table(spark, SF_DIR, "labels")))


def test_held_out_accuracy(spark):
    scored = op9_toxicity(spark, SF_DIR).join(table(spark, SF_DIR, "labels"), "doc_id").filter("held_out").collect()
    toxic = [r.predicted for r in scored if r.toxic == 1]
    clean = [r.predicted for r in scored if r.toxic == 0]
    assert sum(toxic) / len(toxic) >= 0.6 and sum(clean) / len(clean) <= 0.02


def test_rows_without_words(spark, model):
    docs = spark.createDataFrame(
        [(1, None, 2.0), (2, "", 2.0), (2, "", 2.0), (None, "!!! 12", 2.0), (5, "x" * 100_000, 2.0)],
        "doc_id bigint, text string, score double",
    )
    found = tox.toxicity(docs, model).collect()
    assert len(found) == 5 and all(0 <= r.score < 0.7 and r.predicted == 0 for r in found)
    assert tox.toxicity(docs.limit(0), model).collect() == []
    assert {r.score for r in tox.toxicity(docs, None).collect()} == {0.0}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id bigint, toxic int")
    assert tox.fit(tox.sample(docs, labels)) is None
    assert tox.fit([("same words", 1), ("same words here", 0)]) is None


def test_windows_cover_long_words():
    found = tox.windows("ab " + "y" * 30 + "z" * 100)
    assert "ab" in found and all(len(w) <= tox.WINDOW for w in found) and "z" * 48 in found
