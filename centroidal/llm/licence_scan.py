"""Licence scans by a positional index of rare words.

Every licence template is known by its RARE_WORDS words of highest inverse document frequency
in the scanned corpus, each with its places in the template.  The rare words that a file
holds are looked up; a file's place minus a template's place is where the template would
begin, so the postings of a template are intersected by that difference: places that agree
within SLACK words are one alignment, and an alignment that holds enough of the template's
rare words is verified by the template's mandatory key phrases, word by word, inside it.
The phrases that alone make a base label are found everywhere, in any file.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.llm.common import documents

RARE_WORDS = 8  # of a template that are looked up
LEAST_SHARE = 0.6  # of them that must agree on the place
SLACK = 4  # words by which neighbouring rare words may be moved against each other
BASE_SCORE = 0.5  # of a file with a base phrase and no verified template

# Digits, letters in lower case and all bytes beyond ASCII as they are, anything else a space.
_WORD_BYTES = bytes(
    b if b >= 0x80 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(words_of(text.encode("utf-8", "surrogatepass")))


@dataclass(frozen=True)
class Template:
    """The wording of a licence notice and the phrases without which it is not that licence."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @cached_property
    def words(self) -> tuple[bytes, ...]:
        return _words(self.text)

    @cached_property
    def keys(self) -> tuple[tuple[bytes, ...], ...]:
        return tuple(map(_words, self.phrases))


BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The public wording of licence notices and grant lines.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache license version 2 0", "may not use this file except in compliance"),
    ),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template(
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version.",
        ("terms of the gnu general public license", "version 3 of the license"),
    ),
    Template(
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any"
        " later version.",
        ("terms of the gnu general public license", "version 2 of the license"),
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License",
        ("gnu affero general public license",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice, this list"
        " of conditions and the following disclaimer.",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0",),
    ),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template(
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution 4 0",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
        " use, compile, sell, or distribute this software",
        ("free and unencumbered software", "public domain"),
    ),
)


@dataclass(frozen=True)
class Alignment:
    """Where a verified template stands in a file, in words, and the share of its words that are there."""

    template: int
    start: int
    end: int
    share: float


class LicenceIndex:
    """The rare words of some templates with their places, and the scan of one file."""

    def __init__(self, templates: Sequence[Template], phrases: Mapping[str, str], frequencies: Mapping[bytes, int], n_docs: int):
        self.templates, self.labels = templates, phrases
        self.phrases = {phrase: _words(phrase) for phrase in phrases}

        def idf(word: bytes) -> float:
            return math.log((n_docs + 1) / (frequencies.get(word, 0) + 1))

        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed = []
        for number, template in enumerate(templates):
            rare = sorted(set(template.words), key=lambda w: (-idf(w), w))[:RARE_WORDS]
            self.needed.append(math.ceil(LEAST_SHARE * len(rare)))
            for place, word in enumerate(template.words):
                if word in rare:
                    self.postings.setdefault(word, []).append((number, place))
        self.every = licence_words(templates, phrases)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[Alignment]]:
        """``(phrase, start)`` of all base places in order of start, and the verified alignments."""
        present = self.every.intersection(words)
        phrases = [p for p, parts in self.phrases.items() if present.issuperset(parts)]
        rare: Counter[int] = Counter()
        for word in present & self.postings.keys():
            rare.update({number for number, _ in self.postings[word]})
        likely = {number for number, n in rare.items() if n >= self.needed[number]}
        if not phrases and not likely:
            return [], []
        places: dict[bytes, list[int]] = {word: [] for word in present}
        for i, word in enumerate(words):
            if word in present:
                places[word].append(i)
        base = [(p, i) for p in phrases for i in _starts(words, self.phrases[p], places)]
        found = []
        for number in sorted(likely):
            found += self._alignments(number, words, places)
        return sorted(base, key=lambda x: (x[1], x[0])), found

    def _alignments(self, number: int, words: list[bytes], places: Mapping[bytes, list[int]]) -> Iterator[Alignment]:
        template = self.templates[number]
        begins = [
            (i - place, word)
            for word, held in places.items()
            for owner, place in self.postings.get(word, ())
            if owner == number
            for i in held
        ]
        begins.sort()
        keys = None
        first = 0
        for at in range(1, len(begins) + 1):
            if at < len(begins) and begins[at][0] - begins[at - 1][0] <= SLACK:
                continue
            agreeing, first = begins[first:at], at
            if len({word for _, word in agreeing}) < self.needed[number]:
                continue
            if keys is None:
                keys = [(_starts(words, key, places), len(key)) for key in template.keys]
            start = max(0, agreeing[0][0] - SLACK)
            end = min(len(words), agreeing[-1][0] + len(template.words) + SLACK)
            inside = (bisect_right(starts, end - size) - bisect_left(starts, start) for starts, size in keys)
            if all(n > 0 for n in inside):
                yield Alignment(number, start, end, self._share(template, start, end, places))

    @staticmethod
    def _share(template: Template, start: int, end: int, places: Mapping[bytes, list[int]]) -> float:
        there = 0
        for word, n in Counter(template.words).items():
            held = places.get(word, [])
            there += min(n, bisect_left(held, end) - bisect_left(held, start))
        return there / len(template.words)


def licence_words(templates: Sequence[Template], phrases: Mapping[str, str]) -> frozenset[bytes]:
    """All words that the index may ask for; a bounded number, whatever is scanned."""
    own = {w for t in templates for w in (*t.words, *(w for key in t.keys for w in key))}
    return frozenset(own | {w for p in phrases for w in _words(p)})


def _starts(words: list[bytes], phrase: tuple[bytes, ...], places: Mapping[bytes, list[int]]) -> list[int]:
    """All places where the words of a phrase stand one after the other."""
    if not all(w in places for w in phrase):
        return []
    pivot = min(range(len(phrase)), key=lambda k: len(places[phrase[k]]))
    n, wanted = len(phrase), list(phrase)
    return [i - pivot for i in places[phrase[pivot]] if i >= pivot and words[i - pivot : i - pivot + n] == wanted]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))


def word_frequencies(docs: DataFrame, words: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each of a bounded set of words occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                found.update(words.intersection(words_of(text.as_py())))
        rows = [(word, count) for word, count in found.items()] + [(None, n)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], ["word", "n"]
        )

    counts = _texts(docs).select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in counts.collect()}  # one row per licence word
    n_docs = rows.pop(None, 0)
    return rows, n_docs


def licences_found(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Mapping[str, str] = BASE_PHRASES
) -> DataFrame:
    """``(doc_id, n_words, places, licences)``, one row per row of ``docs``.

    ``places`` lists every place of a base phrase as ``(phrase, label, start)`` and ``licences``
    the verified templates as ``(label, start, end, share)``, in words from 0; ``end`` is
    exclusive.  Both are empty for null, empty and clean texts.  Document frequencies are
    those of all rows of ``docs``; ties are broken by the word.  Repeated rows are scanned
    alike, null ids are kept, other columns are not read, texts are taken whole.  An empty
    table gives no rows.
    """
    frequencies, n_docs = word_frequencies(docs, licence_words(templates, phrases))
    index = LicenceIndex(templates, phrases, frequencies, n_docs)
    place = pa.struct([("phrase", pa.string()), ("label", pa.string()), ("start", pa.int64())])
    licence = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places, licences = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                base, found = index.scan(words)
                sizes.append(len(words))
                places.append([(p, index.labels[p], i) for p, i in base])
                licences.append([(templates[a.template].label, a.start, a.end, a.share) for a in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(places, pa.list_(place)),
                    pa.array(licences, pa.list_(licence)),
                ],
                ["doc_id", "n_words", "places", "licences"],
            )

    schema = (
        "doc_id bigint, n_words bigint, places array<struct<phrase: string, label: string, start: bigint>>,"
        " licences array<struct<label: string, start: bigint, end: bigint, share: double>>"
    )
    return _texts(docs).mapInArrow(run, schema)


def summarized(found: DataFrame) -> DataFrame:
    """One row of numbers and label lists for each row of ``licences_found``.

    ``score`` is the largest share of a verified template's words, BASE_SCORE at least where a
    base phrase stands, 0 otherwise.
    """
    starts, base, own = F.col("places.start"), F.col("places.label"), F.col("licences.label")

    def joined(labels) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    share = F.coalesce(F.array_max("licences.share"), F.lit(0.0))
    stands = F.when(F.size("places") > 0, F.lit(BASE_SCORE)).otherwise(0.0)
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.greatest(share, stands).alias("score"),
    )


def op11_licence_scan(spark, sf_dir: str) -> DataFrame:
    return summarized(licences_found(documents(spark, sf_dir)))
