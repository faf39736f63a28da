"""Toxicity by compression distance.

Two zstandard dictionaries are trained from a bounded sample of labelled rows: one holds
wording of toxic texts, the other wording of ordinary texts.  A window of a text (a word, or
48 characters of a longer one) is compressed with both; the bytes that the toxic dictionary
saves over the other are its distance.  A carrier, known to both, surrounds every window, so
that even a short match shows in the length.  A document is as toxic as its worst window,
and a threshold calibrated on the sample turns that into a score.

A dictionary of whole texts would mostly hold what both kinds of text share.  The toxic one
therefore gets the words that begin like a *marked* beginning: a word or beginning of a
word found in many more toxic than ordinary texts.  The ordinary one gets the ordinary words
that the toxic dictionary alone would save bytes on, found in a few rounds.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.llm.common import documents, ids_and_texts, remainder, sole_memory, table, text_slices

FOLDS, HELD_OUT = 3, 1
TOXIC_ROWS, ORDINARY_ROWS = 2000, 4000  # most of each label to learn from
LONGEST_SAMPLE = 50_000  # characters of a text to learn from
THRESHOLD = 0.7
LEAST_AFFIX, MOST_AFFIX = 4, 10  # characters of a beginning
SKETCH, SKETCH_SHARED = 24, 8  # to leave near copies out
LEAST_DOCS, LEAST_Z, LEAST_RATIO = 4, 6.0, 8.0  # for a beginning to be marked
DICTIONARY_BYTES = 48_000
ALARM_WEIGHT = 4.0  # of a toxic verdict on an ordinary text
ROUNDS = 3
WINDOW = 48
KNOWN_WINDOWS = 500_000
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """What tasks need: two dictionaries, the carrier and the calibrated threshold in bytes."""

    carrier: bytes
    toxic: bytes
    ordinary: bytes
    threshold: float


def windows(text: str | None) -> set[str]:
    """The distinct windows of a text."""
    found = set(_WORD.findall((text or "").lower()))
    for word in [w for w in found if len(w) > WINDOW]:
        found.discard(word)
        found.update(word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2))
    return found


class Distance(dict):
    """Bytes saved by the toxic dictionary, by window."""

    def __init__(self, carrier: bytes, toxic: bytes, ordinary: bytes):
        self.carrier = carrier
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        parameters = zstandard.ZstdCompressionParameters(
            compression_level=5,
            strategy=zstandard.STRATEGY_LAZY2,
            min_match=4,
            window_log=17,
            hash_log=15,
            chain_log=15,
            search_log=6,
            target_length=64,
            write_content_size=False,
            write_dict_id=False,
        )
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(compression_params=parameters, dict_data=held)

    def __missing__(self, window: str) -> int:
        # No match starts in the last bytes of the input, so the carrier also follows.
        data = self.carrier + b" " + window.encode("utf-8", "surrogatepass") + b" " + self.carrier
        saved = len(self.ordinary.compress(data)) - len(self.toxic.compress(data))
        if len(self) >= KNOWN_WINDOWS:
            self.clear()
        self[window] = saved
        return saved

    def worst(self, found: set[str]) -> int:
        return max(map(self.__getitem__, found), default=0)


def _beginnings(words: set[str]) -> set[str]:
    out = {w + " " for w in words if len(w) >= LEAST_AFFIX}
    for w in words:
        out.update(w[:k] for k in range(LEAST_AFFIX, min(len(w), MOST_AFFIX)))
    return out


def marked_beginnings(toxic: list[set[str]], ordinary: list[set[str]]) -> list[str]:
    """Beginnings found in many more toxic texts, none of which says the same as another."""
    n_toxic, n_ordinary = len(toxic), len(ordinary)
    in_toxic: Counter[str] = Counter()
    for words in toxic:
        in_toxic.update(_beginnings(words))
    often = {w for w, n in in_toxic.items() if n >= LEAST_DOCS}
    in_ordinary: Counter[str] = Counter()
    for words in ordinary:
        in_ordinary.update(_beginnings(words) & often)

    def is_marked(w: str) -> bool:
        a, b = in_toxic[w], in_ordinary[w]
        share = (a + b) / (n_toxic + n_ordinary)
        spread = math.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_ordinary))
        more = a / n_toxic - b / n_ordinary
        return spread > 0 and more / spread >= LEAST_Z and a / n_toxic >= LEAST_RATIO * (b + 1) / n_ordinary

    marked = {w for w in often if is_marked(w)}
    extended: set[str] = set()  # has a longer one in nearly as many texts
    covered: set[str] = set()  # has a shorter one in many more texts
    for w in marked:
        for v in (w[:k] for k in range(LEAST_AFFIX, len(w)) if w[:k] in marked):
            (extended if in_toxic[w] >= 0.8 * in_toxic[v] else covered).add(v if in_toxic[w] >= 0.8 * in_toxic[v] else w)
    return sorted(marked - extended - covered)


def _joined(words: list[str], size: int) -> bytes:
    """The words in order, the last ones if there is no room for all, filled up in front."""
    return (" " + " ".join(words) + " ").encode()[-size:].rjust(size)


def _unlike(texts: list[set[str]]) -> list[set[str]]:
    """The sets of words without near copies of earlier ones, whose words would count too often.

    Two texts are alike if they share SKETCH_SHARED of the SKETCH smallest hashes of their words.
    """
    holders: dict[int, list[int]] = defaultdict(list)
    kept = []
    for words in texts:
        sketch = sorted(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words)[:SKETCH]
        shared = Counter(i for h in sketch for i in holders[h])
        if max(shared.values(), default=0) < min(SKETCH_SHARED, max(1, len(sketch) // 2)):
            for h in sketch:
                holders[h].append(len(kept))
            kept.append(words)
    return kept


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """Learn from (text, label) rows; None if there is nothing to tell the labels apart."""
    distinct = dict(rows)
    toxic = _unlike([windows(t) for t, label in distinct.items() if label == 1])
    ordinary = _unlike([windows(t) for t, label in distinct.items() if label == 0])
    marks = tuple(m.rstrip() for m in marked_beginnings(toxic, ordinary)) if toxic and ordinary else ()
    if not marks:
        return None
    counts = Counter(w for words in toxic for w in words if w.startswith(marks))
    toxic_words = sorted(counts, key=lambda w: (counts[w], w))
    common = Counter(w for words in ordinary for w in words)
    shared = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:200]]
    carrier = " ".join(shared[:8]).encode()[:40]
    lead = " ".join(shared).encode() + b" "
    size = min(DICTIONARY_BYTES, max(1024, 2 * len(" ".join(toxic_words).encode())))
    toxic_content = lead + carrier + _joined(toxic_words, size)
    hard: list[str] = []
    for _ in range(ROUNDS):
        distance = Distance(carrier, toxic_content, lead + carrier + _joined(hard, size))
        fresh = [w for w in common if w not in counts and distance[w] >= 2]
        if not fresh:
            break
        hard = sorted({*hard, *fresh}, key=lambda w: (common[w], w))
    ordinary_content = lead + carrier + _joined(hard, size)
    distance = Distance(carrier, toxic_content, ordinary_content)
    worst = ([distance.worst(w) for w in toxic], [distance.worst(w) for w in ordinary])
    return Model(carrier, toxic_content, ordinary_content, _calibrated(*worst))


def _calibrated(toxic: list[int], ordinary: list[int]) -> float:
    """The middle of the thresholds with the smallest sum of both error rates, false alarms weighing more."""

    def errors(t: int) -> float:
        alarms = sum(x >= t for x in ordinary) / len(ordinary)
        return sum(x < t for x in toxic) / len(toxic) + ALARM_WEIGHT * alarms

    tried = range(1, max(2, *toxic, *ordinary) + 1)
    least = min(map(errors, tried))
    best = [t for t in tried if errors(t) <= least + 1e-12]
    return (best[0] + best[-1]) / 2


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """A bounded sample of training rows, drawn by a hash of the id.

    Rows without text or label are left out; a document with both labels counts as toxic.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    drawn = None
    for label, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        some = known.filter(F.col("toxic") == label).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(most)
        drawn = some if drawn is None else drawn.union(some)
    drawn = drawn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = (
        ids_and_texts(docs)
        .join(F.broadcast(drawn), "doc_id")  # at most TOXIC_ROWS + ORDINARY_ROWS ids
        .filter(F.length("text").between(1, LONGEST_SAMPLE))
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .collect()
    )
    return sorted((r["text"], r["toxic"]) for r in rows)


@lru_cache(maxsize=2)
def _distance(model: Model) -> Distance:
    return Distance(model.carrier, model.toxic, model.ordinary)


def _forget() -> None:
    _distance.cache_clear()


def score(model: Model | None, text: str | None) -> float:
    """0 to 1, THRESHOLD exactly at the calibrated threshold; without a model 0."""
    if model is None:
        return 0.0
    margin = _distance(model).worst(windows(text)) - model.threshold
    return max(0.0, min(1.0, 1 / (1 + math.exp(-margin) * (1 - THRESHOLD) / THRESHOLD)))


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Null and empty texts have no window and score as a text without a toxic one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("toxicity", _forget)
        for batch in batches:
            for start, end, texts in text_slices(batch):
                scores = [score(model, t) for t in texts]
                rows = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        rows.column("held_out"),
                        pa.array(scores, pa.float64()),
                        pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    held_out = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return (
        ids_and_texts(docs)
        .withColumn("held_out", held_out)
        .mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
    )


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("toxicity", _forget)
        for batch in batches:
            kept = [score(model, t) < THRESHOLD for _, _, texts in text_slices(batch, text) for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    # Python tasks do not take every column name that Spark does.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = plain.columns[docs.columns.index("text")]
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, fit(sample(docs, table(spark, sf_dir, "labels"))))
