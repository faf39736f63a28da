"""Leaks against a plain search, re-parameterised questions and the edge cases."""

import random

from centroidal.llm import decontamination as dec
from centroidal.llm.common import documents, table

QUESTION = "If Anna has 12 apples and gives 5 apples to Ben , how many kg of fruit does Anna carry home when each weighs 3 kg"
OTHER = "If Clara has 40 apples and gives 7 apples to Tom , how many lb of fruit does Clara carry home when each weighs 9 lb"
MIXED = "If Clara has 40 apples and gives 7 apples to Tom , how many lb of fruit does Peter carry home when each weighs 9 ounces"
NOISE = "some plain filler words that nobody would ever put into a benchmark of anything at all"


def find(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, hash string, place int")
    b = spark.createDataFrame([(*r, 0.5) for r in items], "item_id bigint, text string, coverage double")
    return {(r.doc_id, r.item_id): r for r in dec.leaks(d, b).collect()}


def test_reparameterised_questions(spark):
    docs = [
        (1, f"{NOISE}. {QUESTION}. {NOISE}"),
        (2, f"{NOISE} {OTHER} {NOISE}"),
        (3, f"{NOISE}. {MIXED}."),
        (4, NOISE),
        (5, QUESTION.replace("gives", "hands").replace("fruit", "stuff").replace("carry", "bring").replace("many", "much")),
    ]
    found = find(spark, docs, [(7, QUESTION), (8, "something else that has quite enough words to be a window of its own")])
    assert set(found) == {(1, 7), (2, 7)}
    assert not found[1, 7].reparameterised and found[2, 7].reparameterised
    assert found[1, 7].coverage == 1.0 and found[2, 7].consistency == 1.0


def test_odd_rows(spark):
    short = "where does the river end"
    docs = [(1, None), (2, ""), (3, "..."), (4, f"tell me where does the river end now please"), (4, f"tell me where does the river end now please"), (None, QUESTION), (5, f"{NOISE} " * 3000 + QUESTION)]
    items = [(1, short), (1, short), (2, None), (3, ""), (None, QUESTION), (4, QUESTION), (5, "12 13 14"), (6, "Ann Bob")]
    assert set(find(spark, docs, items)) == {(4, 1), (5, 4)}
    assert find(spark, [], items) == {} and find(spark, docs, []) == {}


def test_planted_passages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: " ".join((r.text or "").lower().split()) for r in documents(spark, sf_dir).collect()}
    items = {r.item_id: " ".join(r.text.lower().split()) for r in table(spark, sf_dir, "benchmark").collect()}
    planted = {(d, i) for d, text in docs.items() for i, item in items.items() if item in text}
    found = {(r.doc_id, r.item_id) for r in dec.op2_decontamination(spark, sf_dir).collect()}
    assert planted and planted <= found and len(found) <= len(planted) * 1.05


def plain(docs, items):
    """Every alignment of every item, token by token."""
    out = set()
    for d, text in docs:
        a = dec.tokens(text)
        ha = dec.template(a).tolist()
        for i, item in items:
            b = dec.tokens(item)
            hb = dec.template(b).tolist()
            w = min(8, len(b))
            good = [p for p in range(len(b) - w + 1) if sum(1 - h % 2 for h in hb[p : p + w]) >= dec.LEAST_LITERALS]
            for shift in range(-len(b), len(a)):
                met = [p for p in good if 0 <= p + shift <= len(a) - w and ha[p + shift : p + shift + w] == hb[p : p + w]]
                inside = {k for p in met for k in range(p, p + w) if hb[k] % 2}
                pairs = [(b[k].lower(), a[k + shift].lower()) for k in inside]
                if met and len(met) >= dec.LEAST_COVERAGE * len(good) and dec.consistency(pairs) >= dec.LEAST_CONSISTENCY:
                    out.add((d, i))
    return out


def test_against_plain_search(spark):
    rng = random.Random(8)
    words = ["red", "sea", "tall", "Ann", "Bob", "3", "17", "kg", "lb", "go", "m", "2.5", "why"]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = rng.choices(words, k=rng.randrange(0, 40))
        item = rng.choice(items)[1].split()
        swap = dict(zip(["Ann", "3", "kg"], rng.sample(["Bob", "17", "lb"], 3)))
        text[5:5] = [rng.choice(words) if rng.random() < 0.03 else swap.get(t, t) if d % 2 else t for t in item]
        docs.append((d, " ".join(text)))
    found = set(find(spark, docs, items))
    assert found == plain(docs, items) and len(found) > 20
