"""The rare-word index against a search that tries every place, and hand cases."""

import math
import random
import re
from collections import Counter

from centroidal.llm.licence_scan import (
    BASE_PHRASES,
    BASE_SCORE,
    LEAST_SHARE,
    RARE_WORDS,
    SLACK,
    TEMPLATES,
    LicenceIndex,
    licences_found,
    summarized,
    words_of,
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def holds(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def plain_version(rows):
    """Every start of every template is tried, with no index; one row for each given row."""
    texts = [split(t) for _, t in rows]
    seen = Counter(w for t in texts for w in set(t))
    result = []
    for (doc_id, _), words in zip(rows, texts):
        places = sorted(i for p in BASE_PHRASES for i in holds(words, p.split()))
        base = {label for p, label in BASE_PHRASES.items() if holds(words, p.split())}
        labels, share = set(base), 0.0
        for template in TEMPLATES:
            own = split(template.text)
            rare = sorted(set(own), key=lambda w: (-math.log((len(rows) + 1) / (seen[w] + 1)), w.encode()))[:RARE_WORDS]
            agree = {}
            for begin in range(-len(own), len(words)):
                agree[begin] = {w for p, w in enumerate(own) if w in rare and 0 <= begin + p < len(words) and words[begin + p] == w}
            begins = [b for b in agree if agree[b]]
            while begins:
                group = [begins.pop(0)]
                while begins and begins[0] - group[-1] <= SLACK:
                    group.append(begins.pop(0))
                if len(set().union(*(agree[b] for b in group))) < math.ceil(LEAST_SHARE * len(rare)):
                    continue
                window = words[max(0, group[0] - SLACK) : group[-1] + len(own) + SLACK]
                if all(holds(window, p.split()) for p in template.phrases):
                    labels.add(template.label)
                    share = max(share, sum((Counter(own) & Counter(window)).values()) / len(own))
        score = max(share, BASE_SCORE if places else 0.0)
        ends = (places[0], places[-1]) if places else (None, None)
        result.append((doc_id, len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return result


def table(spark, rows):
    schema = "doc_id bigint, text string, labels string, score int, n_words string"
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema).repartition(3)


def key(row):
    return (row[0] is None, row[0] or 0, *map(str, row[1:]))


def corpus(n):
    rng = random.Random(11)
    filler = "the of software license this public is a use may version under free copy files 漢字 straße x1 2 0 3".split()
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(filler, k=rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(TEMPLATES).text.split(" ")
            for _ in range(rng.randrange(3)):  # words put in, left out or changed
                at = rng.randrange(len(notice))
                notice[at : at + rng.randrange(2)] = rng.choices(filler, k=rng.randrange(2))
            parts += [" ".join(notice), " ".join(rng.choices(filler, k=rng.randrange(30)))]
        rows.append((i, rng.choice([" ", "\n", ".  "]).join(parts)))
    return rows


def test_against_a_search_of_every_place(spark):
    rows = corpus(250)
    rows += [(None, "mit license"), (3, rows[3][1]), (3, rows[3][1]), (7, "MIT LICENSE mit License MIT-license")]
    rows += [(900, None), (901, ""), (902, " \n.!"), (903, "mit licensed"), (904, "general public license apache license")]
    found = sorted(map(tuple, summarized(licences_found(table(spark, rows))).collect()), key=key)
    assert found == sorted(plain_version(rows), key=key)


def test_hand_cases(spark):
    rows = [
        (1, "x y Released under the MIT License."),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "Licensed under the Apache License,\n Version 2.0."),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "A commit license for emit licenses; the cc by 4."),
        (6, "Permission is hereby granted, free of charge, to any good person obtaining a copy of this software and the associated"
            " documentation files, to deal in the Software without restriction, including the rights to use, copy, modify, merge,"
            " publish, distribute, sublicense and/or sell copies of the Software"),
        (7, "Licensed under CC BY 4.0 and also licensed under CC BY-SA 4.0"),
    ] + [(100 + i, "plain words about nothing in particular " * (i + 1)) for i in range(40)]
    found = {r["doc_id"]: r for r in summarized(licences_found(table(spark, rows))).collect()}
    labels = {i: found[i]["labels"] for i in range(1, 8)}
    assert labels == {
        1: "mit", 2: "cc-by-nc-4.0", 3: "apache,apache-2.0", 4: "gpl,gpl-3.0", 5: "", 6: "mit", 7: "cc-by-4.0,cc-by-sa-4.0",
    }
    assert [found[i]["first_word"] for i in (1, 2, 3, 4)] == [5, None, 3, 7]
    assert found[1]["score"] == 1.0 and found[5]["score"] == 0.0 and 0.8 < found[6]["score"] < 1.0
    assert all(found[i]["labels"] == "" and found[i]["n_base"] == 0 for i in range(100, 140))


def test_very_long_and_repetitive_texts(spark):
    rows = [(1, "mit license " * 300_000), (2, "nc " * 500_000 + "licensed under cc by-nc 4.0"), (3, "w" * 3_000_000)]
    found = {r["doc_id"]: r for r in summarized(licences_found(table(spark, rows))).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"]) == (300_000, 0, 599_998)
    assert found[2]["labels"] == "cc-by-nc-4.0"
    assert (found[3]["n_words"], found[3]["labels"]) == (1, "")


def test_empty_table(spark):
    assert summarized(licences_found(table(spark, corpus(1)).limit(0))).collect() == []


def test_words():
    text = "GPL-3.0_or É漢字'x\x7f~a1"
    assert [w.decode() for w in words_of(text.encode())] == split(text)


def test_spans_of_templates():
    index = LicenceIndex(TEMPLATES, BASE_PHRASES, {}, 10)
    words = words_of(("a b c " * 20 + TEMPLATES[1].text + " d e f" * 20).encode())
    base, found = index.scan(words)
    assert base == []
    (only,) = found
    assert only.template == 1 and abs(only.start - 60) <= SLACK and only.share == 1.0
