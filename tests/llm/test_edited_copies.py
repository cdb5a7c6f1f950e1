import random

import pytest

from conftest_llm import odd_texts
from sitescan.llm import edited_copies as E
from sitescan.llm.near_duplicates import simhash


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def similar(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def brute(docs):
    """Smallest id of each class: equal words, SimHash within two bits, or similar shingles."""
    sets = [shingles(t) for _, t in docs]
    prints = [simhash((t or "").encode().lower().split()) & (2**64 - 1) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or similar(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    best = {}
    for (i, _), r in zip(docs, root):
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    return sorted(str(None if gone else i) for gone, i in best.values())


def prose(rng, n):
    return [rng.choice("abcdefghijklmnop") * rng.randint(1, 6) + str(rng.randint(0, 40)) for _ in range(n)]


@pytest.mark.parametrize("pairs", [0, 4])
def test_edited_copies_go(frame, monkeypatch, pairs):
    """``pairs`` 0 makes it take the rounds against one sequence of each bucket."""
    monkeypatch.setattr(E, "PAIRS", pairs)
    rng = random.Random(3)
    common, docs = prose(rng, 40), odd_texts()
    for k in range(12):
        words = prose(rng, rng.randint(30, 200)) + common
        docs.append((100 + k, " ".join(words)))
        for j in range(4):
            copy = list(words)
            for _ in range(max(1, len(words) * (1 + j) // 80)):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            docs.append((1000 + 10 * k + j, " ".join(copy).upper()))
    prints = [simhash((t or "").encode().lower().split()) & (2**64 - 1) for _, t in docs]
    sets = [shingles(t) for _, t in docs]
    far = sum((p ^ q).bit_count() > 2 and similar(a, b) for i, (p, a) in enumerate(zip(prints, sets)) for q, b in zip(prints[:i], sets[:i]))
    assert far >= 10
    df = frame(docs)
    kept = E.deduplicate_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == brute(docs)


def test_nothing_to_compare(frame):
    assert E.deduplicate_copies(frame([])).collect() == []


def test_packed_hashes():
    import numpy as np

    hashes = np.array([0, 1, 2**47 + 5, E._SIZE], np.int64)
    assert E.unpacked(E.packed(hashes)).tolist() == hashes.tolist()
    made = E.shingle_hashes([b"w%d" % i for i in range(5000)])
    assert len(made) == 4996 and made.min() >= 0 and made.max() < E._SIZE


def letters(n, same=86, own=14):
    """Letters of one form that differ in a run of words; none is similar to another."""
    form = [f"form{i}" for i in range(same)]
    return [(k, " ".join(form[:40] + [f"own{k}x{j}" for j in range(own)] + form[40:])) for k in range(n)]


def test_letters_of_one_form_are_no_candidates(spark, frame, monkeypatch):
    asked = []
    whole = E.verified
    monkeypatch.setattr(E, "verified", lambda pairs, sets, similar: asked.append(pairs.count()) or whole(pairs, sets, similar))
    for n in (60, 240):
        kept = E.deduplicate_copies(frame(letters(n), clash=False)).count()
        assert kept == n and sum(asked) <= 4 * n
        asked.clear()


def test_copies_of_different_lengths(spark, frame):
    """The longer of two probes with a longer prefix than the shorter one is indexed with."""
    rng, docs = random.Random(12), []
    for k in range(25):
        words = prose(rng, rng.randint(20, 120))
        docs.append((10 * k, " ".join(words)))
        for j, extra in enumerate((2, len(words) // 6, len(words) // 5 + 4)):
            docs.append((10 * k + j + 1, " ".join(words + prose(rng, extra))))
    kept = E.deduplicate_copies(frame(docs, clash=False))
    assert sorted(str(r.doc_id) for r in kept.collect()) == brute(docs)


def test_shingles_of_very_many_sequences(spark, frame, monkeypatch):
    """All but a few shingles of these are frequent; the order changes, the classes don't."""
    monkeypatch.setattr(E, "FREQUENT", 3)
    rng = random.Random(5)
    parts = [prose(rng, 30) for _ in range(6)]
    docs = []
    for k in range(80):
        chosen = rng.sample(parts, 3)
        docs.append((k, " ".join(sum(chosen, []) + prose(rng, rng.randint(0, 12)))))
    kept = E.deduplicate_copies(frame(docs, clash=False))
    assert sorted(str(r.doc_id) for r in kept.collect()) == brute(docs)
