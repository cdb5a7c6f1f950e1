import re

import pytest

from conftest_llm import odd_texts
from sitescan.llm import decontamination as D
from sitescan.llm.decontamination import decontaminate, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(UPPER))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


ITEMS = [
    (1, "A b, c d e f g h i j k"), (2, "short item"), (2, "short item"), (3, None), (4, "..."), (None, "l m n o p q r s t u v"),
    (10, "one two three four five six seven eight nine ten eleven"), (11, "ten words ünï one two three four five six seven eight nine ten"),
]


def test_equals_brute_force(spark, frame):
    docs = odd_texts() + [
        (20, "x A-B c d e f g h i J! k and short ITEM."), (21, "l m n o p q r s t u v w"), (22, "short. item short item"),
        (23, "one two three four five six seven eight nine ten"), (23, "one two three four five six seven eight nine ten"),
    ]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = find_contamination(frame(docs), items)
    assert {"n_words_", "n_hit_", "item_ids", "contaminated"} <= set(got.columns)
    rows = [(r.doc_id, r.n_words_, r.n_hit_, list(r.item_ids)) for r in got.collect()]
    assert sorted(rows, key=str) == brute(docs, ITEMS)
    assert all(r.contaminated == (r.n_hit_ > 0) for r in got.collect())


def test_empty_tables(spark, frame):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in find_contamination(frame([(1, "a b c")]), nothing).collect()] == [False]
    assert find_contamination(frame([]), nothing).collect() == []


def test_modes(spark, frame):
    items = spark.createDataFrame([(1, "bad bad words")], "item_id long, text string")
    docs = frame([(1, "Keep, bad BAD words!\nthis"), (2, "Clean É text."), (3, None)])
    assert sorted(r.doc_id for r in decontaminate(docs, items).collect()) == [2, 3]
    assert decontaminate(docs, items).columns == docs.columns
    cut = {r.doc_id: r.text for r in decontaminate(docs, items, mode="spans").collect()}
    assert cut == {1: "Keep,   !\nthis", 2: "Clean É text.", 3: None}


@pytest.mark.parametrize("clash", [True, False])
def test_shuffled_join_finds_the_same(frame, spark, monkeypatch, clash):
    """More windows than are broadcast: places and hashes meet in a shuffle, and the words come afterwards."""
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "one two"), (None, "p"), (3, None)], "item_id int, text string")
    docs = frame([*odd_texts(), (50, "x " * 40 + "a b c d e f g h i j k " + "y " * 40), (51, "One, TWO!"), (51, "One, TWO!")], clash)
    whole = sorted(str(r) for r in D.find_contamination(docs, items).collect())
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert sorted(str(r) for r in D.find_contamination(docs, items).collect()) == whole
