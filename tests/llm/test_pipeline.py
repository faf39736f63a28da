"""The pipeline against brute-force stages, and its edge cases."""

import pytest

import corpus_pipeline as pipeline
from centroidal.llm.common import documents, table
from centroidal.llm.substring_dedup import sentences
from tests.llm.test_decontamination import plain as plain_leaks
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_substring_dedup import plain as plain_spans
from tests.llm.test_tokenizing import wanted_digests

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF_DIR)
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in pipeline.toxic_documents_go(spark, docs, SF_DIR).collect()}
    assert kept.items() <= rows.items()
    toxic = {r.doc_id for r in table(spark, SF_DIR, "labels").filter("toxic = 0").collect()}
    assert len(toxic & (rows.keys() - kept.keys())) <= 0.02 * len(toxic)

    prints = {d: plain_fingerprint(t) for d, t in kept.items()}
    roots = plain_components(set(prints.values()))
    first = {}
    for d in sorted(kept):
        first.setdefault(roots[prints[d]], d)
    rows = {d: t for d, t in kept.items() if first[roots[prints[d]]] == d}
    spans = {d: t for d, n, gone, t in plain_spans(rows.items()) if not gone or gone < n}
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    leaked = {d for d, _ in plain_leaks(spans.items(), items)}
    wanted = {(d, *wanted_digests(t)) for d, t in spans.items() if d not in leaked}
    found = pipeline.run(spark, SF_DIR).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    assert columns == pipeline.one_of_each_group_stays(spark, docs, SF_DIR).columns


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:-1]])
def test_odd_rows_in_every_stage(spark, stage):
    long = " ".join(f"word{i} is here, and so on." for i in range(4000))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, carried string, size int"
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long), (None, long), (None, None), (5, "A plain sentence."), (6, " \n ")]
    docs = spark.createDataFrame([(*r, None, "s", 3, 1, "c", 2) for r in rows], schema)
    found = stage(spark, docs, SF_DIR)
    assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
    kept = found.collect()
    assert {5, 3} <= {r.doc_id for r in kept} and {r.carried for r in kept} == {"c"}
    assert stage(spark, docs.limit(0), SF_DIR).collect() == []


DOC = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"thing{i}" for i in range(60))
THIRD = " ".join(f"item{i}" for i in range(60))


def test_texts_under_one_id_are_decided_apart(spark):
    """A clean text stays although its id also names a near copy; so do clean texts without an id."""
    rows = [(3, DOC), (5, DOC), (5, OTHER), (None, DOC), (None, THIRD), (None, THIRD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = pipeline.one_of_each_group_stays(spark, docs, SF_DIR).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, DOC), (5, OTHER), (None, THIRD)], key=str)


def test_leaks_are_decided_apart(spark):
    item = table(spark, SF_DIR, "benchmark").orderBy("item_id").first().text
    rows = [(5, f"{DOC}\n{item}\n{OTHER}"), (5, DOC), (None, f"{DOC}\n{item}\n{OTHER}"), (None, THIRD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = pipeline.benchmark_leaks_go(spark, docs, SF_DIR).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, DOC), (None, THIRD)], key=str)


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:-1]])
def test_columns_of_any_name_stay_as_they_are(spark, stage):
    names = ["doc_id", "text", "text_version", "version", "row", "id", "digest", "carried", "a`b", "gone_id", "its_id", "n_removed", "c.d"]
    rows = [(1, DOC, *"abcdefghijk"), (2, OTHER, *"lmnopqrstuv")]
    docs = spark.createDataFrame(rows, names)
    found = stage(spark, docs, SF_DIR)
    assert found.schema == docs.schema or [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in docs.schema]
    assert sorted(map(tuple, found.collect())) == rows


def test_which_of_rows_alike_in_id_and_text_stays(spark):
    rows = [(1, DOC, "z", None), (1, DOC, "b", 2), (1, DOC, "b", 1), (None, OTHER, "q", 3), (None, OTHER, "p", 4)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, lang string, n_chars bigint").repartition(3)
        kept = pipeline.one_of_each_group_stays(spark, docs, SF_DIR).collect()
        assert sorted(map(tuple, kept), key=str) == [(1, DOC, "b", 1), (None, OTHER, "p", 4)]


def test_encoding_of_odd_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (2, "", 2), (None, "no id", 3), (3, "long " * 300_000, 4), (4, "\n\n  <|endoftext|>", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    found = pipeline.encoded(spark, docs, SF_DIR).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(d, *wanted_digests(t)) for d, t, _ in rows], key=str)
    assert pipeline.encoded(spark, docs.limit(0), SF_DIR).collect() == []


def test_removed_sentences_update_the_length(spark):
    text = "".join(f"Sentence number {i} is here. " for i in range(9))
    docs = spark.createDataFrame([(1, text, len(text)), (2, "Own start here. " + text, 0)], "doc_id bigint, text string, n_chars bigint")
    found = {r.doc_id: r for r in pipeline.repeated_sentences_go(spark, docs, SF_DIR).collect()}
    assert found[1].n_chars == len(text) and found[2].n_chars == len(found[2].text) < len(text)
    assert len(sentences(found[2].text)) < 4


def test_only_marked_texts_are_shuffled(spark):
    """Texts that surely stay are told by a bit map, also where the decisions are too many to broadcast."""
    texts = [f"{i} {DOC[i:]}" for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[9]), (None, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    version = pipeline.text_version(pipeline.F.col("text"))
    marked = docs.filter("doc_id < 5 OR text IS NULL").select(version.alias("v"))
    stay, asked = pipeline._parted(docs, version, marked)
    found = [tuple(r) for r in asked.collect()]
    assert {(i, texts[i]) for i in range(5) if i != 2} | {(2, texts[2]), (2, None), (None, None)} == set(found)
    assert sorted(found + [tuple(r) for r in stay.collect()], key=str) == sorted(rows, key=str)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gone = docs.filter("doc_id < 5").select("doc_id", version.alias("version"))
        left = pipeline._without(docs, gone, version)
        kept = [r.doc_id for r in left.collect()]
        assert sorted(kept, key=str) == sorted((i for i, _ in rows if i is None or i >= 5), key=str)
        assert "BroadcastHashJoin" in left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
