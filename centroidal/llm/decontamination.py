"""Benchmark decontamination by canonical templates.

``leaks`` is the plain form: one alignment at one distance, few-literal windows left out.
``contaminated`` is what the query and the pipeline use, and does the whole job: names of several
words are one slot, the windows of an item may be met at several distances in order, a run of
RUN tokens is enough whatever the item's length, and a second, case-folded literal template
finds exact copies of any item.

Texts become templates: numbers, names (capitalised words) and units turn into typed
placeholders, other words are lower-cased, punctuation goes.  Every window of WINDOW template
tokens is hashed, and windows of documents are joined with windows of benchmark items.  A
question with other numbers, names or units has the same template, so its windows meet too.
Windows at the same distance belong to one alignment of an item with a document; it counts as
a leak if it covers enough of the item's windows and its slots are consistent: what stands in
a slot of the item must be replaced by the same thing wherever it occurs.

A document has a window for every word, few of which are in the benchmark.  A bit map of
fixed size holds the hashes of the benchmark's windows, and only windows found in it enter
the join, whatever the size of either side.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.llm.common import documents, ids_and_texts, sole_memory, table, text_slices, written

WINDOW = 8
LEAST_LITERALS = 4  # of a window's tokens, that are no placeholders
LEAST_COVERAGE = 0.5  # of an item's windows
LEAST_CONSISTENCY = 0.9  # of an alignment's slots
MAP_BITS = 26  # the bit map has 2^26 bits, 8 MB
KNOWN_TOKENS = 500_000
RUN = 13  # matched tokens in a row that are a leak whatever the item's length
DRIFT = 16  # tokens put in or left out between two windows of an ordered alignment

# Units, by what they measure; one unit may replace another of its kind.
UNITS = {
    "length": "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres",
    "mass": "mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces",
    "time": "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years",
    "volume": "ml cl l liter liters litre litres gallon gallons pint pints cup cups",
    "money": "$ € £ ¥ dollar dollars cent cents euro euros usd eur gbp",
    "share": "% percent percentage ‰",
    "speed": "kmh mph knot knots",
    "heat": "°c °f °",
    "power": "w kw mw watt watts v volt volts a amp amps j joule joules kj kcal calorie calories",
}
_KIND = {unit: kind for kind, units in UNITS.items() for unit in units.split()}
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|°[CcFf]?|[$€£¥%‰]")
_SHORT = frozenset("m g s h l w v a j".split())  # units only right after a number


class _Tokens(dict):
    """Hash of each token's template, odd for slots, with a bound on how many are remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        self[token] = value = self._read(token)
        return value

    @staticmethod
    def _read(token: str) -> int:
        low = token.lower()
        if token[0].isdigit():
            return NUMBER
        if low in _KIND and low not in _SHORT:
            return _slot(f"unit {_KIND[low]}")
        if token[0].isupper() and not (len(token) > 1 and token.isupper()):
            return _slot("name")
        return xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & ~1


def _slot(kind: str) -> int:
    return xxhash.xxh3_64_intdigest(f"<{kind}>".encode()) | 1


NUMBER = _slot("number")
_read_token = _Tokens().__getitem__


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text or "")


def template(found: list[str]) -> np.ndarray:
    """Hash of each token's template; odd ones are slots."""
    hashes = np.fromiter(map(_read_token, found), np.uint64, len(found))
    for i in (np.flatnonzero(hashes[:-1] == np.uint64(NUMBER)) + 1).tolist():
        if found[i] in _SHORT:
            hashes[i] = _slot(f"unit {_KIND[found[i]]}")
    return hashes


def windows(hashes: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows with enough literal tokens; fewer tokens than a window are one."""
    size = min(size, len(hashes))
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    slots = np.r_[0, np.cumsum((hashes & np.uint64(1)).astype(np.int64))]
    good = np.flatnonzero(size - (slots[size:] - slots[:n]) >= LEAST_LITERALS)
    return good, mixed[good]


def _windows_of(texts: DataFrame, owner: str, size: int, passing=None) -> DataFrame:
    """``(owner, place, hash, slots, at)``: windows of every text, what stands in their slots, and where.

    ``passing`` is a broadcast (bit map, short sizes): only windows whose hash is in the map,
    of the full size and of the short ones.  Without it all windows, a short text being one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, short = (None, ()) if passing is None else (np.frombuffer(passing.value[0], np.uint8), passing.value[1])
        for batch in batches:
            for start, _, held in text_slices(batch):
                out: list[tuple] = []
                for row, text in enumerate(held, start):
                    found = tokens(text)
                    hashes = template(found)
                    sizes = [min(size, len(found))] if bits is None else [s for s in (*short, size) if s <= len(found)]
                    for width in sizes:
                        places, values = windows(hashes, width)
                        if bits is not None:
                            hit = _in_map(bits, values)
                            places, values = places[hit], values[hit]
                        for place, value in zip(places.tolist(), values.view(np.int64).tolist()):
                            at = [k for k in range(place, place + width) if hashes[k] & np.uint64(1)]
                            slots = [found[k].lower() for k in at]
                            out.append((batch.column(owner)[row].as_py(), place, value, slots, at))
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [owner, "place", "hash", "slots", "at"])

    return texts.mapInArrow(run, f"{owner} bigint, place int, hash bigint, slots array<string>, at array<int>")


def _in_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = values & np.uint64((1 << MAP_BITS) - 1)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bit_map(hashes: DataFrame) -> bytes:
    """The bit map of a column of hashes: a byte for each cell that is used, put together here."""
    cell = F.col("hash").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    used = (
        hashes.select(F.shiftright(cell, 3).alias("cell"), F.pmod(cell, F.lit(8)).alias("bit"))
        .groupBy("cell")
        .agg(F.expr("bit_or(shiftleft(1, cast(bit AS int)))").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    bits[used.column("cell").to_numpy()] = used.column("bits").to_numpy().astype(np.uint8)
    return bits.tobytes()


def consistency(pairs: list[tuple[str, str]]) -> float:
    """The share of slots that agree with the most frequent replacement of the item's value."""
    found: dict[str, Counter[str]] = defaultdict(Counter)
    for old, new in pairs:
        found[old][new] += 1
    return sum(max(c.values()) for c in found.values()) / len(pairs) if pairs else 1.0


def _verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each alignment, whose windows are at most those of its item."""
    for batch in batches:
        kept = []
        for row in batch.to_pylist():
            pairs = {at: (old, new) for w in row["met"] for at, old, new in zip(w["item_at"], w["item_slots"], w["slots"])}
            agreed = consistency(list(pairs.values()))
            changed = any(old != new for old, new in pairs.values())
            kept.append((row["doc_id"], row["item_id"], row["n_windows"], len({w["item_place"] for w in row["met"]}), agreed, changed))
        columns = [pa.array([k[i] for k in kept], t) for i, t in enumerate((*[pa.int64()] * 4, pa.float64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_windows", "n_matched", "consistency", "reparameterised"])


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_matched, coverage, consistency, reparameterised)``.

    One row for each document and item that leaked into it, with the best alignment.  Null
    and empty texts have no windows; an item with fewer than LEAST_LITERALS literal tokens in
    every window cannot be found.  Rows without an id take no part; repeated items and
    documents count once.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = _windows_of(items.filter("item_id is not null").dropDuplicates(), "item_id", size)
    items = items.select("item_id", F.col("place").alias("item_place"), "hash", F.col("slots").alias("item_slots"), F.col("at").alias("item_at"))
    items = written(items, "benchmark-windows")
    sizes = items.groupBy("item_id").agg(F.countDistinct("item_place").alias("n_windows"))
    sized = written(items.join(sizes, "item_id"), "benchmark-windows-sized")
    # Of fixed size, however many windows there are.
    passing = docs.sparkSession.sparkContext.broadcast((_bit_map(items), _short_sizes(benchmark, size)))
    mine = _windows_of(ids_and_texts(docs).filter("doc_id is not null"), "doc_id", size, passing)
    met = mine.join(sized, "hash").filter(F.size("slots") == F.size("item_slots"))
    aligned = met.groupBy("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(
        F.collect_set(F.struct("item_place", "item_slots", "item_at", "slots")).alias("met"), F.max("n_windows").alias("n_windows")
    )
    judged = aligned.select("doc_id", "item_id", "n_windows", "met").mapInArrow(
        _verdict, "doc_id bigint, item_id bigint, n_windows bigint, n_matched bigint, consistency double, reparameterised boolean"
    )
    leaked = judged.withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    leaked = leaked.filter((F.col("coverage") >= LEAST_COVERAGE) & (F.col("consistency") >= LEAST_CONSISTENCY))
    return _best(leaked, ["doc_id", "item_id"])


def _short_sizes(benchmark: DataFrame, size: int) -> tuple[int, ...]:
    """The token counts below a window that items have; fewer than ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {len(tokens(t)) for t in batch.column("text").to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(c for c in counts if 0 < c < size), pa.int32())], ["n"])

    rows = benchmark.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n int").distinct().collect()
    return tuple(sorted(r["n"] for r in rows))


# The whole form: operators are tokens too, names of several words are one slot.
_WIDE_TOKEN = re.compile(_TOKEN.pattern + r"|[+×÷=^−]|(?<=[\d ])[-*/](?= ?\d)")
TEMPLATE, LITERAL = 0, 1  # kinds of windows
_LITERAL_SALT = np.uint64(0x5851F42D4C957F2D)


class _Pairs(dict):
    """Row of each token in ``values``: its template and its case-folded literal."""

    def __init__(self):
        self.values = np.zeros((1024, 2), np.uint64)

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN_TOKENS:
            raise OverflowError
        row = len(self)
        if row == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        folded = token.casefold().encode("utf-8", "surrogatepass")
        self.values[row] = _Tokens._read(token), xxhash.xxh3_64_intdigest(folded)
        self[token] = row
        return row


_pairs = _Pairs()


def _forget() -> None:
    global _pairs
    _pairs = _Pairs()


def _both(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Template and literal hash of each token."""
    global _pairs
    try:
        rows = np.fromiter(map(_pairs.__getitem__, found), np.int64, len(found))
    except OverflowError:
        _pairs = _Pairs()
        if len(set(found)) > KNOWN_TOKENS:  # a text with more distinct tokens than are remembered
            half = len(found) // 2
            return tuple(np.concatenate(x) for x in zip(_both(found[:half]), _both(found[half:])))
        rows = np.fromiter(map(_pairs.__getitem__, found), np.int64, len(found))
    values = _pairs.values[rows]
    return values[:, 0], values[:, 1]


def folded(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template of the units, first token of each, literal of each token); a run of names is one unit."""
    hashes, literals = _both(found)
    for i in (np.flatnonzero(hashes[:-1] == np.uint64(NUMBER)) + 1).tolist():
        if found[i] in _SHORT:
            hashes[i] = _slot(f"unit {_KIND[found[i]]}")
    name = hashes == np.uint64(_slot("name"))
    firsts = np.flatnonzero(~(name & np.r_[False, name[:-1]])) if len(name) else np.zeros(0, np.int64)
    return hashes[firsts], firsts, literals


def _mixed(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window."""
    n = len(hashes) - size + 1
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _literals(hashes: np.ndarray, size: int) -> np.ndarray:
    slots = np.r_[0, np.cumsum((hashes & np.uint64(1)).astype(np.int64))]
    return size - (slots[size:] - slots[: len(hashes) - size + 1])


def _slots_of(found: list[str], hashes: np.ndarray, firsts: np.ndarray, place: int, size: int) -> tuple[list[str], list[int]]:
    ends = np.r_[firsts[1:], len(found)]
    at = [k for k in range(place, place + size) if hashes[k] & np.uint64(1)]
    return [" ".join(found[firsts[k] : ends[k]]).lower() for k in at], at


_ITEM_WINDOWS = "item_id bigint, kind int, item_place int, hash bigint, item_slots array<string>, item_at array<int>, n_windows int, n_units int, size int, whole boolean"


def _item_windows(items: DataFrame) -> DataFrame:
    """Windows of every item, of both kinds.

    Template windows hold LEAST_LITERALS literals.  An item that has no such window gives those
    with any literal and must be met ``whole``, if it has two literals at all.  Literal windows
    are not picked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                found = _WIDE_TOKEN.findall(text or "")
                if not found:
                    continue
                hashes, firsts, literals = folded(found)
                size = min(WINDOW, len(hashes))
                many = _literals(hashes, size)
                places, whole = np.flatnonzero(many >= LEAST_LITERALS), False
                if not len(places) and (hashes & np.uint64(1) == 0).sum() >= 2:
                    places, whole = np.flatnonzero(many), True
                values = _mixed(hashes, size)[places].view(np.int64).tolist()
                for place, value in zip(places.tolist(), values):
                    slots, at = _slots_of(found, hashes, firsts, place, size)
                    out.append((item, TEMPLATE, place, value, slots, at, len(places), len(hashes), size, whole))
                size = min(WINDOW, len(literals))
                values = (_mixed(literals, size) ^ _LITERAL_SALT).view(np.int64).tolist()
                out += [(item, LITERAL, p, v, [], [], len(values), len(literals), size, False) for p, v in enumerate(values)]
            columns = list(zip(*out)) or [()] * 10
            i, n = pa.int32(), pa.int64()
            kinds = (n, i, i, n, pa.list_(pa.string()), pa.list_(i), i, i, i, pa.bool_())
            names = [c.split()[0] for c in _ITEM_WINDOWS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return items.mapInArrow(run, _ITEM_WINDOWS)


def _document_windows(texts: DataFrame, passing) -> DataFrame:
    """``(doc_id, version, place, hash, slots)``: windows of documents whose hash is in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("decontamination", _forget)
        bits, sizes = np.frombuffer(passing.value[0], np.uint8), passing.value[1]
        for batch in batches:
            for start, _, held in text_slices(batch):
                out: list[tuple] = []
                for row, text in enumerate(held, start):
                    found = _WIDE_TOKEN.findall(text or "")
                    if not found:
                        continue
                    hashes, firsts, literals = folded(found)
                    key = None
                    for kind, size in sizes:
                        own = literals if kind == LITERAL else hashes
                        if size > len(own):
                            continue
                        values = _mixed(own, size) ^ (_LITERAL_SALT if kind == LITERAL else np.uint64(0))
                        places = np.flatnonzero(_in_map(bits, values))
                        for place in places.tolist():
                            key = key or (batch.column("doc_id")[row].as_py(), batch.column("version")[row].as_py())
                            slots = [] if kind == LITERAL else _slots_of(found, hashes, firsts, place, size)[0]
                            out.append((*key, place, int(values[place].view(np.int64)), slots))
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()))
                names = ["doc_id", "version", "place", "hash", "slots"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return texts.mapInArrow(run, "doc_id bigint, version bigint, place int, hash bigint, slots array<string>")


def diagonals(places: np.ndarray, item_places: np.ndarray) -> Iterator[list[int]]:
    """The pairs of each distance, in order, the most numerous distance first."""
    shifts = places - item_places
    order = np.lexsort((places, shifts))
    starts = np.flatnonzero(np.r_[True, np.diff(shifts[order]) != 0])
    parts = np.split(order, starts[1:])
    for part in sorted(parts, key=lambda x: (-len(x), int(shifts[x[0]]))):
        yield part.tolist()


def chains(places: np.ndarray, item_places: np.ndarray, least: int = 1) -> Iterator[list[int]]:
    """Ordered alignments of several distances, each the longest of what the ones before left.

    From one window to the next both places grow and their distance changes by DRIFT at most.
    Alignments only get shorter; those of fewer than ``least`` pairs are left out.
    """
    shifts = places - item_places
    left = np.lexsort((item_places, places))
    while len(left) >= least:
        p, q, s = places[left], item_places[left], shifts[left]
        best, back = np.ones(len(left), np.int64), np.full(len(left), -1)
        for j in range(1, len(left)):
            fits = (p[:j] < p[j]) & (q[:j] < q[j]) & (abs(s[:j] - s[j]) <= DRIFT)
            if fits.any():
                # Of the longest the one at the nearest distance: a plain run is not left for another.
                score = np.where(fits, best[:j] * (2 * DRIFT) - abs(s[:j] - s[j]), -1)
                back[j] = int(score.argmax())
                best[j] = best[back[j]] + 1
        j, chain = int(best.argmax()), []
        while j >= 0:
            chain.append(j)
            j = int(back[j])
        if len(chain) < least:
            return
        yield left[chain[::-1]].tolist()
        left = np.delete(left, chain)


def alignments(row: dict, places: np.ndarray, item_places: np.ndarray) -> Iterator[list[int]]:
    """What a region and an item may be judged by: single distances first, then what bends between them."""
    yield from diagonals(places, item_places)
    if not row["whole"] and len(np.unique(places - item_places)) > 1:
        least = min(math.ceil(LEAST_COVERAGE * row["n_windows"]), math.ceil(RUN / row["size"]))
        yield from chains(places, item_places, max(1, least))


def _longest_run(hits: list[dict], size: int) -> int:
    """Most tokens in a row that windows at one distance cover."""
    best = run = 0
    for before, hit in zip([None, *hits], hits):
        step = hit["place"] - before["place"] if before else 0
        joined = before and step == hit["item_place"] - before["item_place"] and step <= size
        run = run + step if joined else size
        best = max(best, run)
    return best


_JUDGED = "doc_id bigint, version bigint, item_id bigint, n_windows bigint, n_matched bigint, consistency double, reparameterised boolean"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The alignments of a document's region and an item that are leaks."""
    for batch in batches:
        kept = []
        for row in batch.to_pylist():
            met = row["met"]
            places, item_places = (np.array([m[c] for m in met], np.int64) for c in ("place", "item_place"))
            # No alignment has more windows than the region or the item has among the pairs.
            most = min(len(np.unique(places)), len(np.unique(item_places)))
            for chain in alignments(row, places, item_places):
                hits = [met[k] for k in chain]
                matched = len({h["item_place"] for h in hits})
                enough = matched >= row["n_windows"] if row["whole"] else matched >= LEAST_COVERAGE * row["n_windows"]
                if not (enough or _longest_run(hits, row["size"]) >= RUN and not row["whole"]):
                    continue
                slots = {at: (old, new) for h in hits for at, old, new in zip(h["item_at"], h["item_slots"], h["slots"])}
                # A name at either end of the item may be one with names of the text around it.
                inner = [pair for at, pair in slots.items() if 0 < at < row["n_units"] - 1]
                agreed = consistency(inner)
                if agreed >= LEAST_CONSISTENCY:
                    changed = any(old != new for old, new in slots.values())
                    kept.append((row["doc_id"], row["version"], row["item_id"], row["n_windows"], matched, agreed, changed))
                    if matched >= most and agreed == 1 and not changed:
                        break  # none can be better
        columns = list(zip(*kept)) or [()] * 7
        kinds = (*[pa.int64()] * 5, pa.float64(), pa.bool_())
        names = [c.split()[0] for c in _JUDGED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, version, item_id, n_windows, n_matched, coverage, consistency, reparameterised)``.

    One row for each text and item that leaked into it, with the best alignment.  ``version`` is
    ``xxhash64(text)``: rows alike in id and text are one, others are judged apart; null ids
    are ids.  A text is looked at in overlapping regions of twice an item's reach, so that
    repeated passages make more rows, not larger ones.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(_item_windows(items.filter("item_id is not null").dropDuplicates()), "benchmark-windows")
    sizes = [(r["kind"], r["size"]) for r in items.select("kind", "size").distinct().collect()]
    passing = docs.sparkSession.sparkContext.broadcast((_bit_map(items), sorted(sizes)))
    texts = ids_and_texts(docs).withColumn("version", F.xxhash64("text"))
    met = _document_windows(texts, passing).join(items, "hash").filter(F.size("slots") == F.size("item_slots"))
    reach = F.col("n_units") * 2 + 2 * WINDOW
    region = F.floor(F.col("place") / reach)
    regions = met.withColumn("region", F.explode(F.array(region, region - 1)))
    # An item id may have several texts.
    keys = ["doc_id", "version", "item_id", "kind", "region", "n_windows", "n_units", "size", "whole"]
    aligned = regions.groupBy(*keys).agg(F.collect_set(F.struct("place", "item_place", "item_slots", "item_at", "slots")).alias("met"))
    leaked = aligned.drop("kind", "region").mapInArrow(_judged, _JUDGED)
    leaked = leaked.withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    return _best(leaked, ["doc_id", "version", "item_id"])


def _best(leaked: DataFrame, keys: list[str]) -> DataFrame:
    best = F.max(F.struct("coverage", "consistency", (~F.col("reparameterised")).alias("same"), "n_matched", "n_windows"))
    return (
        leaked.groupBy(*keys)
        .agg(best.alias("best"))
        .select(*keys, "best.n_windows", "best.n_matched", "best.coverage", "best.consistency", (~F.col("best.same")).alias("reparameterised"))
    )


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir).filter("doc_id is not null"), table(spark, sf_dir, "benchmark"))
    return _best(found, ["doc_id", "item_id"])
