import random

import numpy as np

from strandloom.llm import decontaminate as D

from .helpers import clashing, corpus, empty, table

ITEM = "If Ada buys 12 apples for 3 dollars each and Ada sells 5 of them, how much does Ada have left after 2 days?"


def matches(item, text):
    raw = text.encode()
    return D.Benchmark([1], [item]).matches(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))


def test_templates_and_slots():
    assert matches(ITEM, f"Before. {ITEM} after")[0][-1] is True
    other = ITEM.replace("Ada", "Bob").replace("12", "40").replace("dollars", "euros")
    assert matches(ITEM, "so: " + other)[0][-1] is False
    assert matches(ITEM, ITEM.lower().replace("ada", "ADA") + "!!!")
    assert matches(ITEM, "If Rome Paris Oslo Kiel Bonn 4 5 6 7 8 9 10 11 12 13") == []
    assert matches(ITEM, "") == [] and matches("", ITEM) == [] and matches("only four short words", "x only four short words y")


def test_inconsistent_slots_do_not_count():
    item = "we saw Tom and Tom and Tom and Tom and Tom and Tom and Tom"
    assert matches(item, item.replace("Tom", "Kim"))
    names = iter(("Ana", "Ben", "Cid", "Dan", "Eva", "Flo", "Gus"))
    mixed = " ".join(next(names) if w == "Tom" else w for w in item.split())
    got = matches(item, mixed)
    assert not got or got[0][4] < matches(item, item)[0][4]


def test_items_of_dense_slots():
    for item, other in (
        ("What is 12 times 7?", "What is 9 times 31?"),
        ("Solve 3 x + 5 = 20 for x", "Solve 8 x + 2 = 90 for x"),
        ("Add 12 km, 15 km, 18 km, 20 km, 31 km and 44 km, then halve it.", "Add 2 mi, 5 mi, 8 mi, 10 mi, 21 mi and 34 mi, then halve it."),
    ):
        assert [m[-1] for m in matches(item, f"so {item} and on")] == [True]
        assert [m[-1] for m in matches(item, f"so {other} and on")] == [False]
    # one value for two, and slots alone, which are found verbatim
    assert matches("What is 12 times 7?", "What is 9 times 9?") == []
    assert matches("12 7 19 3", "so 12 7 19 3 and on") and matches("12 7 19 3", "so 12 7 19 4 and on") == []
    # the slots at both ends of a long item are covered too
    item = "1 2 3 4 5 6 7 8 9 of them were sold by noon and 11 12 13 14 15 16 17 18 19"
    text = "21 22 23 24 25 26 27 28 29 of them were sold by noon and 31 32 33 34 35 36 37 38 39"
    assert matches(item, f"so {text} then")[0][4] == 25 and matches(item, item)[0][4] == 25


def test_names_that_begin_sentences():
    item = "Tom has 3 apples. Tom gives 2 apples to Ann. Tom buys 4 more. How many apples does Tom have?"
    other = "Sam has 7 apples. Sam gives 5 apples to Eve. Sam buys 9 more. How many apples does Sam have?"
    (found,) = matches(item, f"An exercise:\n{other}\nThe end.")
    assert found[4] == found[5] == 20 and found[-1] is False
    assert matches(item, f"An exercise:\n{item}\nThe end.")[0][-1] is True
    # one name for two breaks the one to one map
    mixed = other.replace("Eve", "Sam")
    assert matches(item, mixed)[0][4] < 20
    assert matches("Who is Tom?", "Rome is Paris. Anna is Eve.") == [] and matches("Who is Tom?", "well, Who is Tom?")


def test_planted_items(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"{rng.choice('bcdfg')}{rng.choice(['ar', 'on', 'il'])}{rng.randrange(90)}q" for _ in range(rng.randrange(6, 40)))) for i in range(30)] + [(99, None), (98, "")]
    rows = corpus(7)
    planted = set()
    out = []
    for k, r in enumerate(rows):
        if r[1] and k % 5 == 0:
            item = items[k % 30]
            out.append((r[0], f"{r[1]} {item[1].upper()}. {r[1]}", *r[2:]))
            planted.add((r[0], item[0]))
        else:
            out.append(r)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = clashing(table(spark, out))
    for block in (20_000, 7):  # also in several scans
        monkeypatch.setattr(D, "BLOCK_ITEMS", block)
        assert {(r.doc_id, r.item_id) for r in D.contamination(docs, bench).collect()} == planted
        kept = D.without_contaminated(docs, bench)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in out if r[0] not in {p[0] for p in planted})
    assert D.contamination(empty(spark), bench).count() == 0 and D.contamination(docs, bench.limit(0)).count() == 0 and D.without_contaminated(docs, bench.limit(0)).count() == len(out)
