"""Ranked search against a full scan, and the pruning of the tree."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from sitescan.llm import fp_ranking
from sitescan.llm.fp_ranking import Best, build_tree, impact_of, rank_documents, search, terms_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, queries, best=10):
    vectors = [(i, Counter(words(t))) for i, t in docs]
    some = [(i, c) for i, c in vectors if c]
    total, length = len(some), sum(sum(c.values()) for _, c in some)
    df = Counter(t for _, c in some for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in some:
            m = 100 - 75 + (75 * sum(c.values()) * total) // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in words(text) if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(q, k + 1, i, -s) for k, (s, _, i) in enumerate(scored[:best])]
    return sorted(out, key=str)


def ranked(docs, queries, **options):
    made = rank_documents(docs, queries, **options)
    return sorted((tuple(r) for r in made.select(queries.columns[0], *made.columns[-3:]).collect()), key=str)


@pytest.fixture
def asked(spark):
    return lambda pairs: spark.createDataFrame(pairs, "item_id bigint, text string")


def test_terms(monkeypatch):
    texts = ["", "a", "Ünï ÇØDÉ ß_漢字😀x\x00y\x7fZ", "one two 3a,4B", "x" * 50 + " y " * 30]
    whole = [[t.decode() for run in terms_of(t_.encode()) for t in run] for t_ in texts]
    monkeypatch.setattr(fp_ranking, "_CUT", 5)
    assert whole == [words(t) for t in texts] == [[t.decode() for run in terms_of(t_.encode()) for t in run] for t_ in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=12), min_size=1, max_size=60), st.integers(1, 6), st.data())
def test_search_equals_a_scan(bags, bucket, data):
    vectors = [np.array(sorted(set(b))) for b in bags]
    counts = [np.array([b.count(t) for t in sorted(set(b))]) for b in bags]
    m = np.array([25 + 3 * len(b) for b in bags])
    docs, absent = np.arange(len(bags)) // 2, np.array([i % 5 == 0 for i in range(len(bags))], np.int64)
    tree = build_tree(vectors, counts, m, docs, absent, 10, bucket)
    chosen = np.array(sorted(data.draw(st.sets(st.integers(0, 9), min_size=1))))
    weights = np.array([data.draw(st.integers(0, 50)) for _ in chosen])
    weight_of = np.zeros(10, np.int64)
    weight_of[chosen] = weights
    best = Best(4)
    search(tree, chosen, weights, weight_of, best)
    scores = [
        (-int((weight_of[v] * impact_of(c, m[i])).sum()), int(absent[i]), int(docs[i])) for i, (v, c) in enumerate(zip(vectors, counts))
    ]
    assert [(-s, a, d) for s, a, d in sorted(s for s in scores if s[0] < 0)[:4]] == [tuple(r) for r in best.rows.tolist()]


def test_tree_shares_paths_and_prunes():
    draw = np.random.default_rng(3)
    vectors = [np.unique(np.concatenate([[0, 1, 2], draw.integers(3, 300, 6)])) for _ in range(3000)]
    counts = [np.ones(len(v), np.int64) for v in vectors]
    tree = build_tree(vectors, counts, np.full(3000, 100), np.arange(3000), np.zeros(3000, np.int64), 300)
    assert len(tree.first) < 4 * 3000 / fp_ranking.BUCKET + 2
    rare, weight_of = vectors[1500][-3:], np.zeros(300, np.int64)
    weight_of[rare] = 1000
    best = Best(1)
    scored = search(tree, rare, weight_of[rare], weight_of, best)
    leaves = int((tree.end == np.arange(len(tree.end)) + 1).sum())
    assert best.rows[0, 0] == 3 * 1000 * int(impact_of(np.array([1]), np.array([100]))[0]) and scored < leaves / 2


def test_small_tables(spark, frame, asked):
    texts = [(i, " ".join(f"w{(i * k) % 13}" for k in range(i % 9))) for i in range(80)] + odd_texts()
    queries = [(1, "w1 w2 W1"), (2, None), (3, "nothing"), (1, "w1 w2 W1"), (None, "one two ünï"), (7, "w0 " * 30 + "word a")]
    docs = frame(texts)
    want = brute(texts, queries)
    assert ranked(docs, asked(queries)) == want
    assert ranked(docs, asked(queries), pass_terms=2) == want
    assert ranked(docs.limit(0), asked(queries)) == ranked(docs, asked(queries).limit(0)) == []


def test_clashing_names_and_ties(spark, frame):
    texts = [(i, "same words here") for i in (9, 4, 7, None, 1, 4)] + [(i, "other") for i in range(20, 40)]
    queries = spark.createDataFrame([(1, "same", "x", "y", "z")], "item_id int, text string, rank string, doc_id string, score string")
    made = rank_documents(frame(texts), queries, best=5)
    assert made.columns == ["item_id", "text", "rank", "doc_id", "score", "rank_", "doc_id_", "score_"]
    assert [r.doc_id_ for r in made.orderBy("rank_").collect()] == [1, 4, 4, 7, 9]


def test_trees_of_a_few_documents(spark, frame, asked, monkeypatch):
    monkeypatch.setattr(fp_ranking, "TREE", 1)
    monkeypatch.setattr(fp_ranking, "BUCKET", 2)
    texts = [(i, " ".join(f"w{(i * i + k) % 17}" for k in range(1 + i % 6))) for i in range(200)]
    queries = [(q, f"w{q} w{q + 3} w{2 * q}") for q in range(12)]
    assert ranked(frame(texts, clash=False), asked(queries)) == brute(texts, queries)
