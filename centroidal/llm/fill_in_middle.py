"""Fill-in-the-middle transformation as a pipeline of pyarrow.compute steps.

A batch of texts is split into lists of lines; the lists are flattened with the index of the
row that each line belongs to; a line's ordinal inside its row and the row's two cuts give
its role; the lines of a role are rebuilt into lists and joined, and the pieces of a row are
joined with the sentinels in the order of its form.  No step loops over rows or lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centroidal.llm.common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED = 7
PERCENT = 100  # of the documents that can be transformed
SPM_PERCENT = 50  # of the transformed ones: suffix first
SLICE_BYTES = 32_000_000  # of text transformed at once; a longer text is a slice of its own
PLAIN, PSM, SPM = "plain", "psm", "spm"

_RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def check_sentinels(sentinels: Sequence[str]) -> None:
    """Sentinels must be found again in an output, wherever a piece of text begins or ends."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are required")
    for a in sentinels:
        for b in sentinels:
            inside = a != b and a in b
            if inside or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"the sentinels {a} and {b} overlap")


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first words of a hash of seed and id.

    A null id counts as no digits.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def text_parts(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        below = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, below + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lines with their end marks, the row of each, and its ordinal in the row."""
    lists = pc.split_pattern(texts, "\n")
    values, parents = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    sizes = pc.list_value_length(lists).to_numpy()
    starts = np.cumsum(sizes) - sizes
    ordinals = np.arange(len(values)) - starts[parents]
    last = ordinals == sizes[parents] - 1
    empty = pc.equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    ended = pc.binary_join_element_wise(values, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    units = pc.if_else(pa.array(last), values, ended)
    # What follows the last end mark is a line unless nothing does.
    kept = ~(last & empty)
    return units.filter(pa.array(kept)), parents[kept], ordinals[kept]


def _joined(units: pa.Array, parents: np.ndarray, chosen: np.ndarray, rows: int) -> pa.Array:
    """The chosen lines of each row as one text."""
    sizes = np.bincount(parents[chosen], minlength=rows)
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int64())
    lists = pa.LargeListArray.from_arrays(offsets, units.filter(pa.array(chosen)))
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def _transformed(batch: pa.RecordBatch, sentinels: Sequence[str], percent: int, spm_percent: int) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    rows = len(texts)
    units, parents, ordinals = _lines(texts)
    n = np.bincount(parents, minlength=rows)
    h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
    first, second = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(first, second)[parents], np.maximum(first, second)[parents]

    prefix = _joined(units, parents, ordinals < low, rows)
    middle = _joined(units, parents, (ordinals >= low) & (ordinals < high), rows)
    suffix = _joined(units, parents, ordinals >= high, rows)

    plain = pc.equal(pc.binary_length(texts), 0)
    for sentinel in sentinels:
        plain = pc.or_(plain, pc.match_substring(texts, sentinel))
    plain = pc.or_(plain, pa.array(h3 % 100 >= percent))
    suffix_first = pa.array(h4 % 100 < spm_percent)
    p, s, m = (pa.scalar(x, pa.large_string()) for x in sentinels)
    nothing = pa.scalar("", pa.large_string())
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
    output = pc.if_else(plain, texts, pc.if_else(suffix_first, spm, psm))
    form = pc.if_else(plain, PLAIN, pc.if_else(suffix_first, SPM, PSM))
    none = pa.scalar(None, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(n.astype(np.int64)),
            form,
            pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
            pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
            output.cast(pa.string()),
        ],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def filled_in_middle(
    docs: DataFrame,
    seed: int = SEED,
    percent: int = PERCENT,
    spm_percent: int = SPM_PERCENT,
    sentinels: Sequence[str] = SENTINELS,
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per row of ``docs``.

    ``n`` is the number of lines, a line being what ends with a line feed, or the rest.  Two
    draws from a hash of the id choose the cuts between lines, the others the form: ``psm``,
    ``spm``, or ``plain``, the unchanged text, whose pieces are null.  Null and empty texts
    are plain and have no lines; texts that hold a sentinel are plain.  Rows with equal ids
    get equal draws, repeated rows equal results; columns other than id and text are not
    read.  Texts are taken whole; an empty table gives no rows.
    """
    check_sentinels(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text"):
                yield _transformed(part, sentinels, percent, spm_percent)

    drawn = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id").cast("bigint"), seed), 1)],
    )
    return drawn.mapInArrow(run, _RESULT)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output of ``filled_in_middle`` was made of."""
    p, s, m = sentinels

    def after(text: Column, mark: str) -> Column:
        """What follows the first ``mark``; a text without it is whole."""
        return F.substring(text, F.locate(mark, text) + F.lit(len(mark)), F.length(text))

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    psm = F.concat(after(before(output, s), p), after(output, m), after(before(output, m), s))
    spm = F.concat(after(before(output, m), p), after(output, m), after(before(output, p), s))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = filled_in_middle(documents(spark, sf_dir))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


# The same by cutting at character places; the restored text by the places of the sentinels.
OP12_SQL = f"""
WITH given AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
units AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u,
        [CAST('0x' || substr(d, 1 + 8 * i, 8) AS BIGINT) for i in range(4)] AS h FROM given),
cuts AS (
    SELECT *, len(u) AS n, h[1] % (len(u) + 1) AS a, h[2] % (len(u) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= {PERCENT}
            THEN 'plain' WHEN h[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
    SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p,
        coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
        coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') AS s FROM cuts),
made AS (
    SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts),
placed AS (SELECT *, instr(o, '<P>') AS ip, instr(o, '<S>') AS si, instr(o, '<M>') AS im FROM made)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(o) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN o
        WHEN 'psm' THEN substr(o, 4, si - 4) || substr(o, im + 3) || substr(o, si + 3, im - si - 3)
        ELSE substr(o, ip + 3, im - ip - 3) || substr(o, im + 3) || substr(o, 4, ip - 4) END) AS restored_sha256
FROM placed
"""
