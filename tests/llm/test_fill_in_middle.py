"""Fill-in-the-middle against a plain version, its own inverse, and SQL."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from centroidal.llm.fill_in_middle import OP12_SQL, check_sentinels, filled_in_middle, restored

TEXTS = [
    None,
    "",
    "\n",
    "\n\n\n",
    "one line",
    "one line\n",
    "first\nsecond\nthird",
    "first\n\nthird\n\n",
    "carriage\r\nreturns\rstay here\n\x0b\x0cx",
    "naïve\n漢字\n🙂🏽\n" * 7,
    "holds <P> a mark\nx",
    "holds <S>\n",
    "<M>",
    "almost <P\n>S<\n<",
    "<\nP>\n<S\n>",
    "word " * 200_000 + "\n" + "x" * 1_000_000,
    "line\n" * 50_000,
]


def plain_version(doc_id, text, seed=7, percent=100, spm_percent=50, marks=("<P>", "<S>", "<M>")):
    p, s, m = marks
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in marks) or h3 % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h4 % 100 < spm_percent:
        return doc_id, n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return doc_id, n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def table(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x", 9) for i, t in rows], "doc_id bigint, text string, output string, n int"
    ).repartition(3)


def key(row):
    return (row[0] is None, row[0] or 0, row[-1])


@pytest.mark.parametrize("options", [{}, {"seed": 1, "percent": 60, "spm_percent": 10}, {"marks": ("[a]", "[b]", "[c]")}])
def test_against_plain_version(spark, options):
    rows = [(i + 100 * k, t) for k in range(4) for i, t in enumerate(TEXTS)]
    rows += [(None, "no\nid\n"), (3, "a\nb\nc"), (3, "a\nb\nc"), (3, "other\ntext")]
    given_options = {("sentinels" if k == "marks" else k): v for k, v in options.items()}
    found = [tuple(r) for r in filled_in_middle(table(spark, rows), **given_options).collect()]
    wanted = [plain_version(i, t, **options) for i, t in rows]
    assert sorted(found, key=key) == sorted(wanted, key=key)


def test_restores_every_text(spark):
    rows = [(i + 100 * k, t) for k in range(8) for i, t in enumerate(TEXTS)]
    made = filled_in_middle(table(spark, rows)).select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert dict(map(tuple, made.collect())) == {i: t or "" for i, t in rows}


def test_restores_with_other_sentinels(spark):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    made = filled_in_middle(table(spark, rows), seed=3, sentinels=marks)
    back = made.select("doc_id", restored(F.col("output"), F.col("form"), marks).alias("text"))
    assert dict(map(tuple, back.collect())) == {i: t or "" for i, t in rows}


def test_empty_table(spark):
    assert filled_in_middle(table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("marks", [("a", "b", ""), ("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("xy", "axyb", "c")])
def test_sentinels_that_cannot_be_found_again(marks):
    with pytest.raises(ValueError):
        check_sentinels(marks)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab\n<>PSM é🙂\r"), max_size=40), min_size=1, max_size=40))
def test_any_text(spark, texts):
    rows = list(enumerate(texts))
    found = sorted(tuple(r) for r in filled_in_middle(table(spark, rows)).collect())
    assert found == sorted(plain_version(i, t) for i, t in rows)


def test_sql_says_the_same(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no\nid")]
    made = filled_in_middle(table(spark, rows)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256),
    )
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(con.execute(OP12_SQL).fetchall(), key=key)
