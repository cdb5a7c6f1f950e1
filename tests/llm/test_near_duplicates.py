import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest_llm import odd_texts
from sitescan.llm import near_duplicates as N


def plain_hash(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(points):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("sample, shard", [(10_000, 40), (150, 64), (3, 10), (0, 100)])
def test_search_equals_brute_force(sample, shard):
    rng = np.random.default_rng(2)
    far = rng.integers(-2**63, 2**63 - 1, 500)
    flip = lambda x: x ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63)))
    points = np.unique(np.array([*far, *map(flip, far[:200]), *(flip(flip(far[0])) for _ in range(300)), 0, 1, 3, -1], dtype=np.int64))
    forest = N.fit_forest(points[: min(sample, len(points))] if sample < len(points) else points, len(points), shard)
    leaf, query, rows = N.addresses(points, forest, 2)
    assert sorted(rows[~query]) == list(range(len(points)))
    a, b = [], []
    for k in np.unique(leaf):
        home, sent = points[rows[(leaf == k) & ~query]], points[rows[(leaf == k) & query]]
        if len(home):
            x, y = N.shard_links(home, sent, 2)
            a, b = [*a, *x], [*b, *y]
    got = N.stars(len(points), np.searchsorted(points, a).astype(int), np.searchsorted(points, b).astype(int))
    assert list(got) == brute([int(p) & (2**64 - 1) for p in points])


def test_components(spark):
    random.seed(4)
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (139, 300), (300, 139)]
    random.shuffle(chain)
    got = {r.node: r.root for r in N.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {i: 100 for i in [*range(101, 140), 300]}
    assert got == want
    assert N.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_classes_equal_brute_force(frame):
    random.seed(5)
    prose = [" ".join(random.choice("abcdefghij") * random.randint(1, 4) for _ in range(300)) for _ in range(15)]
    docs = odd_texts() + [(100 + i, p) for i, p in enumerate(prose)] + [(50 + i, p + " end") for i, p in enumerate(prose)]
    got = N.near_duplicate_classes(frame(docs)).collect()
    assert len(got) == len(docs)
    prints = [plain_hash(t) for _, t in docs]
    root = brute(prints)
    first = {}
    for (i, _), r in zip(docs, root):
        if i is not None:
            first[r] = min(i, first.get(r, i))
    want = sorted(((i, f"{p:016x}", first.get(r)) for (i, _), p, r in zip(docs, prints, root)), key=str)
    assert sorted(((r.doc_id, r.fingerprint_, r.component_id_) for r in got), key=str) == want
    assert {r.fingerprint_ for r in got if not (r.text or "").strip()} == {"0" * 16}


def test_one_of_each_class_stays(frame):
    docs = frame([(5, "x y z w"), (3, "x y z w"), (3, "x y z w"), (None, "x y z w"), (9, None), (8, ""), (None, "other words here")])
    kept = N.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "x y z w"), ("8", ""), ("None", "other words here")]
    assert N.deduplicate(frame([])).collect() == []


def test_spark_hashes_alike(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", seed=42)
