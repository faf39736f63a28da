"""Divergence of the sources of a language by a recount over minimal perfect hashes.

The first pass counts, exactly, in how many documents of a language each term occurs, and
keeps the frequent ones.  They are built into sharded minimal perfect hashes with stored
keys.  The second pass gets the shards by broadcast, in rounds of at most ROUND_BYTES, and
increments one dense array of slots for each (language, source) group that a task meets, so
nothing is shuffled but the non-zero slots.  Sums over the kept terms of two sources come
from dense blocks of slots and sources; a slot that no source of a block has counted adds a
constant, which is multiplied in at the end.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centroidal.llm.common import documents, written
from centroidal.llm.perfect_hash import PerfectHashes, Shard, build, key_hashes, shard_of, stored_key

LEAST_DOCUMENTS = 10
ONE = 1_000_000_000  # what probabilities are shares of
SMOOTHING = 2
TOP_TERMS = 10
KEYS_PER_SHARD = 50_000  # on average
ROUND_BYTES = 96_000_000  # of shards that are broadcast at once
HELD_TERMS = 400_000  # distinct terms that a task counts before it sends them on
SLICE_BYTES = 8_000_000  # of text split into terms at once
DENSE_SLOTS = 32_000_000  # in all dense arrays of a task; beyond it they are sent on
CHUNK_SLOTS = 2048  # of a block whose sources are compared
BLOCK_SOURCES = 256

# Letters in lower case and all bytes beyond ASCII as they are, anything else a space.
_TERM_BYTES = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _plain(docs: DataFrame) -> DataFrame:
    """``(lang, source, text binary)`` without nulls."""

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return docs.select(known("lang").alias("lang"), known("source").alias("source"), known("text").cast("binary").alias("text"))


def _by_group(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple[str, ...], list[bytes]]]:
    """Texts of a batch by group, a bounded amount at a time."""
    keys = list(zip(*(batch.column(n).to_pylist() for n in names)))
    texts = batch.column("text")
    held: dict[tuple[str, ...], list[bytes]] = {}
    size = 0
    for i, key in enumerate(keys):
        text = texts[i].as_py()
        held.setdefault(key, []).append(text)
        size += len(text)
        if size >= SLICE_BYTES:
            yield from held.items()
            held, size = {}, 0
    yield from held.items()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(lang, term binary, documents)``: in how many documents of a language a term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                terms = list(counts)
                for start in range(0, len(terms), 50_000):
                    part = terms[start : start + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(part), pa.string()),
                            pa.array(part, pa.binary()),
                            pa.array([counts[t] for t in part], pa.int64()),
                        ],
                        ["lang", "term", "documents"],
                    )
            found.clear()

        for batch in batches:
            for (lang,), texts in _by_group(batch, ["lang"]):
                counts = found.setdefault(lang, Counter())
                before = len(counts)
                for text in texts:
                    counts.update(set(terms_of(text)))
                held += len(counts) - before
                if held >= HELD_TERMS:
                    yield from sent()
                    held = 0
        yield from sent()

    partial = _plain(docs).select("lang", "text").mapInArrow(run, "lang string, term binary, documents bigint")
    return partial.groupBy("lang", "term").agg(F.sum("documents").alias("documents"))


def perfect_hash_shards(kept: DataFrame, n_shards: int) -> DataFrame:
    """``(shard, n, size, widths, bits, keys, langs, terms)``, one row per shard with keys."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist())
            hashes = np.array([key_hashes(lang.encode(), [term])[0] for lang, term in pairs], np.uint64)
            shard = pa.array(shard_of(hashes, n_shards).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("term"), shard, pa.array(hashes.view(np.int64))],
                ["lang", "term", "shard", "hash"],
            )

    def pack(rows: pa.Table) -> pa.Table:
        widths, bits, slots = build(rows.column("hash").to_numpy().view(np.uint64))
        ordered = rows.take(pa.array(np.argsort(slots)))
        langs, terms = ordered.column("lang").to_pylist(), ordered.column("term").to_pylist()
        keys = [stored_key(lang.encode(), term) for lang, term in zip(langs, terms)]
        return pa.table(
            {
                "shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()),
                "n": pa.array([len(keys)], pa.int64()),
                "size": pa.array([len(bits) + sum(map(len, keys)) + 8 * len(keys)], pa.int64()),
                "widths": pa.array([widths.tolist()], pa.list_(pa.int64())),
                "bits": pa.array([bits.tobytes()], pa.binary()),
                "keys": pa.array([keys], pa.list_(pa.binary())),
                "langs": pa.array([langs], pa.list_(pa.string())),
                "terms": pa.array([terms], pa.list_(pa.binary())),
            }
        )

    placed = kept.select("lang", "term").mapInArrow(number, "lang string, term binary, shard int, hash bigint")
    schema = (
        "shard int, n bigint, size bigint, widths array<bigint>, bits binary, keys array<binary>,"
        " langs array<string>, terms array<binary>"
    )
    return placed.groupBy("shard").applyInArrow(pack, schema)


def _rounds(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Consecutive shards of at most ``most`` bytes, one at least."""
    rounds: list[list[int]] = []
    held = most
    for shard, size in sizes:
        if held + size > most or not rounds:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += size
    return rounds


def _recounted(plain: DataFrame, hashes, dense_slots: int) -> DataFrame:
    """``(lang, source, slot, n)`` of the terms that the broadcast shards hold, partly summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, first, end = hashes.value
        dense: dict[tuple[str, str], np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(at), pa.string()),
                        pa.array([source] * len(at), pa.string()),
                        pa.array(at + first),
                        pa.array(counts[at]),
                    ],
                    ["lang", "source", "slot", "n"],
                )
            dense.clear()

        for batch in batches:
            for (lang, source), texts in _by_group(batch, ["lang", "source"]):
                counts: Counter = Counter()
                for text in texts:
                    counts.update(terms_of(text))
                if not counts:
                    continue
                terms, space = list(counts), lang.encode()
                slots = index.slots(key_hashes(space, terms), [stored_key(space, t) for t in terms])
                held = slots >= 0
                if not held.any():
                    continue
                if (lang, source) not in dense:
                    if (len(dense) + 1) * (end - first) > dense_slots:
                        yield from sent()
                    dense[lang, source] = np.zeros(end - first, np.int64)
                numbers = np.fromiter(counts.values(), np.int64, len(terms))
                dense[lang, source][slots[held] - first] += numbers[held]  # a term has one slot, once
        yield from sent()

    return plain.mapInArrow(run, "lang string, source string, slot bigint, n bigint")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(ONE * (count + 2) / (total + 2 * kept)) without overflow: three decimal digits at a time."""
    divisor = total + SMOOTHING * kept
    rest, quotient = count + SMOOTHING, F.lit(0).cast("bigint")
    for _ in range(3):
        scaled = rest * 1000
        quotient = quotient * 1000 + _div(scaled, divisor)
        rest = scaled % divisor
    return quotient + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _pair_sums(counts: DataFrame, groups: DataFrame, chunk_slots: int, block_sources: int) -> DataFrame:
    """``(lang, a, b, seen, value)`` for groups a < b of a language, by position.

    ``value`` sums over ``seen`` slots; in all other slots neither group has a count.
    Rows travel once for each block of sources that theirs is compared with, so a task holds
    ``chunk_slots`` slots of two blocks at most, however many sources a language has.
    """
    block = _div(F.col("position"), F.lit(block_sources)).cast("int")
    last = _div(F.col("members") - 1, F.lit(block_sources)).cast("int")
    other = F.explode(F.sequence(F.lit(0), last)).alias("other")

    def sides(df: DataFrame) -> DataFrame:
        spread = df.select("*", block.alias("block"), other)
        return spread.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    own = groups.select("lang", "source", F.col("position").alias("position"), F.col("members").alias("members"))
    placed = counts.join(own, ["lang", "source"])
    left = sides(placed.withColumn("chunk", _div(F.col("slot"), F.lit(chunk_slots)))).select(
        "lang", "chunk", "low", "high", "position", "slot", "n"
    )
    # The groups of a block, once for each chunk of slots in which it has a count.
    met = left.select("lang", "chunk", "low", "high").distinct().toDF("its_lang", "its_chunk", "its_low", "its_high")
    same = (F.col("lang") == F.col("its_lang")) & (F.col("low") == F.col("its_low")) & (F.col("high") == F.col("its_high"))
    right = sides(groups).select("lang", "low", "high", "position", "total", "kept").join(met, same)
    right = right.select("lang", F.col("its_chunk").alias("chunk"), "low", "high", "position", "total", "kept")

    def compare(rows: pa.Table, members: pa.Table) -> pa.Table:
        low = members.column("low")[0].as_py() if members.num_rows else 0
        position = members.column("position").to_numpy()
        order = np.argsort(position)
        position, total = position[order], members.column("total").to_numpy()[order]
        divisor = total + SMOOTHING * members.column("kept").to_numpy()[order]
        slots, column = np.unique(rows.column("slot").to_numpy(), return_inverse=True)
        counts = np.full((len(position), len(slots)), SMOOTHING, np.int64)
        counts[np.searchsorted(position, rows.column("position").to_numpy()), column] += rows.column("n").to_numpy()
        shares = np.zeros_like(counts)
        for _ in range(3):
            counts *= 1000
            shares = shares * 1000 + counts // divisor[:, None]
            counts %= divisor[:, None]
        shares += 1
        first = int(np.count_nonzero(position // block_sources == low))
        several = bool(members.num_rows) and members.column("high")[0].as_py() != low
        a, b, values = [], [], []
        for i in range(first):
            others = np.arange(first if several else i + 1, len(position))
            gap = shares[others] - shares[i]
            values.append((gap * gap // (shares[others] + shares[i])).sum(axis=1))
            a.append(np.full(len(others), position[i]))
            b.append(position[others])
        n = sum(map(len, a))
        lang = members.column("lang")[0].as_py() if members.num_rows else None
        return pa.table(
            {
                "lang": pa.array([lang] * n, pa.string()),
                "a": pa.array(np.concatenate(a) if a else np.zeros(0, np.int64), pa.int64()),
                "b": pa.array(np.concatenate(b) if b else np.zeros(0, np.int64), pa.int64()),
                "seen": pa.array(np.full(n, len(slots)), pa.int64()),
                "value": pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()),
            }
        )

    keys = ["lang", "chunk", "low", "high"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, "lang string, a bigint, b bigint, seen bigint, value bigint"
    )
    return sums.groupBy("lang", "a", "b").agg(F.sum("seen").alias("seen"), F.sum("value").alias("value"))


def kept_counts(
    docs: DataFrame, least_documents: int, keys_per_shard: int, round_bytes: int, dense_slots: int
) -> tuple[DataFrame, DataFrame]:
    """``(slot, lang, term binary)`` of the kept terms, and ``(lang, source, slot, n)`` of their counts."""
    spark = docs.sparkSession
    frequent = document_frequencies(docs).filter(F.col("documents") >= least_documents)
    kept = written(frequent.select("lang", "term"), "kept-terms")
    total = kept.count()
    n_shards = max(1, -(-total // keys_per_shard))
    shards = written(perfect_hash_shards(kept, n_shards), "perfect-hashes")
    held = sorted((r["shard"], r["n"], r["size"]) for r in shards.select("shard", "n", "size").collect())
    first_slots, slot = {}, 0
    for shard, n, _ in held:
        first_slots[shard] = slot
        slot += n
    counted = None
    for numbers in _rounds([(shard, size) for shard, _, size in held], round_bytes):
        rows = shards.filter(F.col("shard").isin(numbers)).select("shard", "widths", "bits", "keys").toArrow()
        packed = [
            Shard(s, np.array(w, np.int64), b, k.values)
            for s, w, b, k in zip(
                rows.column("shard").to_pylist(), rows.column("widths").to_pylist(),
                rows.column("bits").to_pylist(), rows.column("keys"),
            )
        ]
        index = PerfectHashes(packed, first_slots, n_shards)
        first = first_slots[numbers[0]]
        end = first + len(index.keys)
        found = _recounted(_plain(docs), spark.sparkContext.broadcast((index, first, end)), dense_slots)
        found = written(found.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), "recount")
        counted = found if counted is None else counted.unionByName(found)
    if counted is None:
        counted = spark.createDataFrame([], "lang string, source string, slot bigint, n bigint")
    starts = spark.createDataFrame(list(first_slots.items()), "shard int, first bigint")  # one row per shard
    slots = shards.join(starts, "shard").select(F.posexplode(F.arrays_zip("langs", "terms")).alias("at", "key"), "first")
    return slots.select((F.col("first") + F.col("at")).alias("slot"), "key.langs", "key.terms").toDF("slot", "lang", "term"), counted


def source_divergences(
    docs: DataFrame,
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    keys_per_shard: int = KEYS_PER_SHARD,
    round_bytes: int = ROUND_BYTES,
    dense_slots: int = DENSE_SLOTS,
    chunk_slots: int = CHUNK_SLOTS,
    block_sources: int = BLOCK_SOURCES,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    A language keeps the terms that occur in ``least_documents`` of its documents at least;
    repeated rows are documents of their own.  Part ``pair`` lists every other source of the
    language with the summed divergence over the kept terms, part ``term`` the ``top_terms``
    kept terms that a group uses most above its language.  Null text, language and source
    are the empty string, also as an item; empty texts count as documents without terms, and
    a group without terms still has its pairs.  Columns other than these three are not read.
    An empty table gives no rows.  A term of any length is one term.
    """
    slots, found = kept_counts(docs, least_documents, keys_per_shard, round_bytes, dense_slots)
    counts = written(found, "group-counts")
    kept = slots.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    own = Window.partitionBy("lang")
    groups = (
        _plain(docs).select("lang", "source").distinct()
        .join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
        .fillna(0, ["total", "kept"])
        .withColumn("position", F.row_number().over(own.orderBy("source")).cast("bigint") - 1)
        .withColumn("members", F.count("*").over(own))
    )
    groups = written(groups, "groups")

    sums = written(_pair_sums(counts, groups, chunk_slots, block_sources), "pair-sums")
    zero = _share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept"))
    one = groups.filter("kept > 0").withColumn("zero", zero).unionByName(
        groups.filter("kept = 0").withColumn("zero", F.lit(1).cast("bigint"))
    )
    a = one.select("lang", F.col("source").alias("source"), F.col("position").alias("pa"), "kept", F.col("zero").alias("za"))
    b = one.select("lang", F.col("source").alias("item"), F.col("position").alias("pb"), F.col("zero").alias("zb"))
    pairs = (
        a.join(b, "lang").filter("pa != pb")  # these are the rows of the result
        .withColumns({"a": F.least("pa", "pb"), "b": F.greatest("pa", "pb")})
        .join(sums, ["lang", "a", "b"], "left")
    )
    unseen = (F.col("kept") - F.coalesce("seen", F.lit(0))) * _gap(F.col("za"), F.col("zb"))
    value = F.when(F.col("kept") > 0, F.coalesce("value", F.lit(0)) + unseen).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("bigint").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    per_slot = counts.groupBy("slot").agg(F.sum("n").alias("all"))
    per_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shares = (
        counts.join(per_slot, "slot")
        .join(groups.select("lang", "source", "total", "kept"), ["lang", "source"])
        .join(per_lang, "lang")
        .withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))
        .withColumn("q", _share(F.col("all"), F.col("lang_total"), F.col("kept")))
        .filter("p > q")
    )
    named = shares.join(slots.select("slot", "term"), "slot").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
        _gap(F.col("p"), F.col("q")).alias("value"),
    )
    terms = named.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergences(documents(spark, sf_dir))


OP13_SQL = f"""
WITH given AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM given),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCUMENTS}),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM given),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups g LEFT JOIN cells x ON x.lang = g.lang AND x.source = g.source GROUP BY ALL),
shares AS (
    SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c,
        1 + ({ONE}::HUGEINT * (coalesce(c, 0) + {SMOOTHING})) // (n.n + {SMOOTHING} * v) AS p
    FROM n JOIN kept k ON k.lang = n.lang JOIN size s ON s.lang = n.lang
    LEFT JOIN cells x ON x.lang = n.lang AND x.source = n.source AND x.term = k.term),
whole AS (
    SELECT lang, term, 1 + ({ONE}::HUGEINT * (sum(c) + {SMOOTHING})) // (sum(sum(c)) OVER (PARTITION BY lang) + {SMOOTHING} * any_value(v)) AS q
    FROM cells JOIN size USING (lang) GROUP BY lang, term),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
    SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((p - q) * (p - q)) // (p + q) AS value
    FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
