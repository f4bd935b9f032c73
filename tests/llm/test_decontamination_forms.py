"""Items in other letter case, with other numbers and names, short ones, and a naive matcher on random items."""

import re

import numpy as np
import pytest

from tessera.llm import decontaminate
from test_text_operators import corpus

NAMED = "Alice has 3 apples and Bob gives 2 to Carol"
OPENING = "Zebulon has 3 pens. Ingrid takes 2 away from the desk. How many are left on it?"
SHORT = "What is 12 + 30?"
CAPITAL = "What is the old name of that river?"
TABLE = "1 2 3 4 5 6 7 8"


def held(spark, texts, items):
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(corpus(spark, [(i, t, "s") for i, t in enumerate(texts)]), b).collect()
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in got}


def test_forms_of_items(spark):
    forms = [
        (NAMED, 0, False), (NAMED.lower(), 0, False), (NAMED.upper(), 0, False), ("Emma has 7 apples and Liam gives 5 to Olivia", 0, True),
        ("alice has 9 apples and bob gives 4 to carol", 0, True), ("Yusuf has 7 pens. Tariq takes 5 away from the desk. How many are left on it?", 1, True),
        ("so " + OPENING.upper() + " AND MORE", 1, False), ("he asked: what is 12 + 30? nobody knew", 2, False), ("Tell me. What is 7 + 5? Now.", 2, True),
        ("see Question What is the old name of that river? Alice knows", 3, False), ("the row 1 2 3 4 5 6 7 8 was there", 4, False), ("page " * 50 + NAMED + " word" * 20_000, 0, False),
    ]
    clean = ["Yusuf has 7 pens. Tariq sells them at the market on the hill near the old town.", "the row 8 7 6 5 4 3 2 1 was there", "What is it? 12 + 30", "", None, "x"]
    got = held(spark, [t for t, _, _ in forms] + clean, [NAMED, OPENING, SHORT, CAPITAL, TABLE, None, ""])
    assert got == {(i, item): other for i, (_, item, other) in enumerate(forms)}


def test_borders_of_names_do_not_matter(spark):
    item = "Alice has 3 apples. Alice gives 2 of them to her friend Bob"
    assert held(spark, [f"see Question {item} Carol looked on", item.replace("Bob", "Bob Miller")], [item]).keys() == {(0, 0), (1, 0)}


def naive(doc, item):
    """Whether the words of item stand in doc in a row, up to letter case and a one-to-one change of numbers."""
    d, b = (re.findall(r"\w+", x.lower()) for x in (doc, item))
    for at in range(len(d) - len(b) + 1):
        there, back = {}, {}
        if all(there.setdefault(y, x) == x and back.setdefault(x, y) == y if x.isdigit() and y.isdigit() else x == y for x, y in zip(d[at:], b)):
            return True
    return False


@pytest.mark.parametrize("seed", [1, 2])
def test_random_items_as_the_naive_matcher(spark, seed):
    rng = np.random.default_rng(seed)
    word = lambda: str(rng.integers(1, 90)) if rng.random() < 0.15 else f"w{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}"
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(int(rng.integers(7, 40))) for _ in range(25)]
    docs = []
    for i in range(120):
        item = items[rng.integers(25)].split()
        form = i % 5
        if form == 1:
            new = {x: str(100 + k) for k, x in enumerate(sorted({x for x in item if x.isdigit()}))}
            item = [new.get(x, x) for x in item]
        if form == 2:
            item = [x.upper() for x in item]
        if form == 3:
            item = [str(rng.integers(1000)) if x.isdigit() else x for x in item[: len(item) // 2]]
        if form == 4:
            item = [x if rng.random() < 0.5 else f"other{x}" for x in item]
        docs.append(f"{text(int(rng.integers(0, 60)))} x {' '.join(item)} y {text(int(rng.integers(0, 60)))}")
    want = {(i, k) for i, d in enumerate(docs) for k, b in enumerate(items) if naive(d, b)}
    assert len(want) >= 72 and set(held(spark, docs, items)) == want
