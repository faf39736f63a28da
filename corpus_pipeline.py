"""A corpus cleaned and encoded in five stages, each of which calls one corpus operator.

Every stage but the last returns the columns of ``documents``.  A decision names a row by its
id and a hash of its text, also where the id is null, so texts that share an id are decided
one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from centroidal.llm.common import documents, quoted, table, text_version, unused, written
from centroidal.llm.decontamination import contaminated
from centroidal.llm.simhash import superfluous
from centroidal.llm.streaming_bpe import VOCABULARY, bpe_round_trips
from centroidal.llm.substring_dedup import deduplicated
from centroidal.llm.tokenizer import vocabulary_file
from centroidal.llm.toxicity import fit, sample, without_toxic

# No SQL: a compressor, a fingerprint and a tokenizer decide; tests hold it against brute force.
ORACLE_SQL = None


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go; learned from the labels of what is there."""
    return without_toxic(docs, fit(sample(docs, table(spark, sf_dir, "labels"))))


MAP_BITS = 26  # of the bit map of text versions, 8 MB
PART_BITS = 15  # of them in one row, as bitmap_construct_agg makes it


def _parted(docs: DataFrame, version: Column, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose version is surely not among those ``marked``, and all others, few of which are not.

    Versions are looked up in a broadcast bit map of fixed size, so the texts that surely stay
    are not shuffled, however many are marked.
    """
    cell = F.pmod(F.col("version"), F.lit(1 << MAP_BITS))
    place = cell.bitwiseAND(F.lit((1 << PART_BITS) - 1))
    bits = marked.toDF("version").select(F.shiftright(cell, PART_BITS).alias("part"), place.alias("place"))
    bits = bits.groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits"))
    own = unused("text_version", docs.columns)
    part, held = (unused(name, [*docs.columns, own]) for name in ("map_part", "map_bits"))
    bits = written(bits, "bit-map").toDF(part, held)
    cell = F.pmod(F.col(own), F.lit(1 << MAP_BITS))
    place = cell.bitwiseAND(F.lit((1 << PART_BITS) - 1))
    byte = F.conv(F.hex(F.substring(F.col(held), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    looked_up = docs.withColumn(own, version).join(F.broadcast(bits), F.shiftright(cell, PART_BITS) == F.col(part), "left")
    columns = list(map(quoted, docs.columns))
    return looked_up.filter(~hit).select(*columns), looked_up.filter(hit).select(*columns)


def _exactly_without(docs: DataFrame, decided: DataFrame, version: Column) -> DataFrame:
    own = unused("text_version", docs.columns)
    gone = decided.toDF("gone_id", "gone_version")
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone["gone_id"]) & (F.col(own) == gone["gone_version"])
    return docs.withColumn(own, version).join(gone, same, "left_anti").select(*map(quoted, docs.columns))


def _without(docs: DataFrame, decided: DataFrame, version: Column) -> DataFrame:
    """The rows of ``docs`` whose id and text version are not among those ``decided`` upon."""
    stay, asked = _parted(docs, version, decided.select(decided.columns[1]))
    return stay.union(_exactly_without(asked, decided, version))


def _versions_alike(docs: DataFrame) -> DataFrame:
    """Text versions that an id has more than once."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_version(F.col("text")).alias("version"))
    return keyed.groupBy("id", "version").agg(F.count("*").alias("n")).filter("n > 1").select("version")


def _one_of_alike(docs: DataFrame) -> DataFrame:
    """Of rows alike in id and text the first in the order of their other columns, written as JSON.

    Each task sends on one of a group.
    """
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(quoted(c)) for c in names]).alias("row"),
        F.col("doc_id").cast("bigint").alias("id"),
        text_version(F.col("text")).alias("version"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
    )
    others = [F.col(f"row.{quoted(c)}") for c in names if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    return keyed.groupBy("id", "version", "digest").agg(F.min_by("row", order).alias("row")).select("row.*")


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the text with the smallest id stays; rows alike in id and text are one.

    Null ids come after all others.  Texts under one id are judged apart.  Only rows that the
    bit map points out are compared with the decisions and with one another.
    """
    goes = written(superfluous(docs), "near-duplicates")
    version = text_version(F.col("text"))
    stay, asked = _parted(docs, version, goes.select("version").union(_versions_alike(docs)))
    return stay.union(_one_of_alike(_exactly_without(asked, goes, version)))


def repeated_sentences_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of sentence spans go, and documents of which nothing else is left."""
    found = deduplicated(docs).filter("n_removed = 0 or n_removed < n_sentences")
    changed = F.col("n_removed") > 0

    def column(name: str) -> Column:
        if name in ("doc_id", "text"):
            return F.col(name).cast(docs.schema[name].dataType).alias(name)
        own = F.col(f"carried.{quoted(name)}")
        return (F.when(changed, F.length("text")).otherwise(own) if name == "n_chars" else own).cast(docs.schema[name].dataType).alias(name)

    return found.select([column(c) for c in docs.columns])


def benchmark_leaks_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units, go."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaked = written(found.select("doc_id", "version").distinct(), "leaks")
    return _without(docs, leaked, F.xxhash64(F.col("text").cast("string")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe_round_trips(docs, vocabulary_file(VOCABULARY))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near duplicates", one_of_each_group_stays),
    ("repeated sentences", repeated_sentences_go),
    ("benchmark leaks", benchmark_leaks_go),
    ("byte pairs", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to ``documents``; each result is written before the next stage reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
