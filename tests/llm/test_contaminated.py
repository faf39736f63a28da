"""What one alignment at one distance, or windows with few literals left out, would not find."""

import pytest

from centroidal.llm import decontamination as dec

ITEM = (
    "The steam train that leaves New York at 9 in the morning carries 240 people to the coast , and the slower one "
    "that leaves at 11 carries only 75 of them because its oldest wagons were sold last winter"
)
NOISE = "some plain filler words that nobody would ever put into a benchmark of anything at all"
LONG = " ".join(f"{a}{b}" for a in ("al", "be", "co", "du", "el", "fo", "gu") for b in ("ran", "sil", "tom", "vek", "wun", "xor", "zap"))
SUM = "What is 48 + 7 + 12 ?"
TITLE = "The Old Man And The Sea"


def find(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in dec.contaminated(d, b).collect()}


def around(text):
    return f"{NOISE} {text} {NOISE}"


MIDDLE = ITEM.split()
OTHER_NAME = ITEM.replace("New York", "Paris").replace("240", "90")
ONE_MORE = " ".join([*MIDDLE[:18], "indeed", *MIDDLE[18:]])


@pytest.mark.parametrize(
    "text, item",
    [
        (OTHER_NAME, ITEM),
        (ONE_MORE, ITEM),
        (" ".join([*MIDDLE[:18], *MIDDLE[19:]]), ITEM),
        (" ".join(LONG.split()[20:34]), LONG),
        (ITEM.lower(), ITEM),
        (ITEM.upper(), ITEM),
        (SUM, SUM),
        (SUM.replace("48", "31").replace("12", "9"), SUM),
        (TITLE, TITLE),
        (TITLE.lower(), TITLE),
        ("12 13 14", "12 13 14"),
        ("Ann Bob", "Ann Bob"),
    ],
)
def test_leaks_that_a_single_alignment_misses(spark, text, item):
    assert (1, 7) in find(spark, [(1, around(text)), (2, around(NOISE))], [(7, item)])


def test_what_is_no_leak(spark):
    half = LONG.split()
    docs = [
        (1, around(" ".join(half[20:30]))),  # a run below RUN of a long item
        (2, around("12 13 15")),
        (3, around("What is 48 - 7 + 12 ?")),
        (4, around("Her Young Son And His Boat")),
        (5, around(ITEM.replace("New York", "Paris").replace("carries only", "brings just").replace("leaves", "starts").replace("people", "men").replace("slower", "next").replace("oldest", "best"))),
    ]
    assert find(spark, docs, [(1, LONG), (2, "12 13 14"), (3, SUM), (4, TITLE), (5, ITEM)]) == {}


def test_versions_and_null_ids(spark):
    docs = [(1, around(ITEM)), (1, NOISE), (None, around(ITEM)), (None, None), (2, "")]
    found = find(spark, docs, [(7, ITEM), (7, "another text of the same number that is nowhere to be seen"), (8, None), (9, "")])
    assert set(found) == {(1, 7), (None, 7)}
    assert len({r.version for r in found.values()}) == 1 and not found[1, 7].reparameterised


def test_regions(spark):
    text = " ".join([NOISE] * 7 + [ITEM]) + " "
    for start in range(0, 120, 17):
        docs = [(1, "word " * start + text * 40 + ONE_MORE), (2, "word " * start + ONE_MORE)]
        assert set(find(spark, docs, [(7, ITEM)])) == {(1, 7), (2, 7)}


def test_repetitive_items_and_texts(spark):
    """Equal tokens match everywhere; the plain distance that covers all of them settles it."""
    import time

    items = [(1, "la " * 200), (2, "0 " * 200), (3, "spam eggs " * 60)]
    rows = [(1, "x y z " + "la " * 230), (2, "la " * 150 + "and something else"), (3, "la " * 20), (4, "eggs spam " * 400), (5, "0 " * 300)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    start = time.perf_counter()
    found = {(r.doc_id, r.item_id) for r in dec.contaminated(docs, benchmark).collect()}
    assert {(1, 1), (2, 1), (4, 3)} <= found and not {(3, 3), (4, 1), (1, 3)} & found
    assert time.perf_counter() - start < 120


def test_alignments_of_a_repetitive_region_are_judged_in_time():
    import time

    import numpy as np

    places, item_places = (x.ravel() for x in np.meshgrid(np.arange(193), np.arange(193)))
    start = time.perf_counter()
    first = next(dec.alignments({"whole": False, "n_windows": 193, "size": 8}, places, item_places))
    assert time.perf_counter() - start < 1
    assert [(int(places[i]), int(item_places[i])) for i in first] == [(i, i) for i in range(193)]
