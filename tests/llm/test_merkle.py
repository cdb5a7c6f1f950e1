"""Manifest trees against a plain recursion, and the versions of tampered rows."""

from hashlib import sha256
from zlib import crc32

import pytest
from conftest_llm import odd_texts
from pyspark.sql import functions as F

from sitescan.llm.merkle import build_manifest, verify_rows


def alter():
    return {"altered": {"text": F.translate("text", "\n", "")}, "where": F.crc32(F.col("doc_id").cast("string")) % 2 == 0}



def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(*fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def raise_all(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def brute(rows, arity=3):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text)."""
    made = []
    for doc_id, source, lang, n_chars, text in rows:
        tampered = doc_id is not None and crc32(str(doc_id).encode()) % 2 == 0
        new = text.replace("\n", "") if tampered and text is not None else text
        made.append((source, doc_id, leaf_of(doc_id, source, lang, n_chars, text), leaf_of(doc_id, source, lang, n_chars, new)))
    made.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    names = list(dict.fromkeys(r[0] for r in made))
    groups = {s: [r for r in made if r[0] == s] for s in names}
    trees = {s: raise_all([r[2] for r in g], arity) for s, g in groups.items()}
    top, out = raise_all([trees[s][-1][0] for s in names], arity) if names else [], []
    for k, s in enumerate(names):
        for at, (_, doc_id, leaf, new) in enumerate(groups[s]):
            proof, folded = "", new
            for levels, i in ((trees[s], at), (top, k)):
                for nodes in levels[:-1]:
                    low = i - i % arity
                    left, right = "".join(nodes[low:i]), "".join(nodes[i + 1:low + arity])
                    proof, folded, i = proof + left + right, h(left + folded + right), i // arity
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def documents(spark, sizes, repeat=False):
    rows, i = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((i, f"line {i}\nline", None if i % 5 == 0 else "en", source, None if i % 7 == 0 else i))
            i += 1
    if repeat:
        rows += rows[:: max(1, len(rows) // 9)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("sizes, arity, depth", [
    ({"a": 1}, 3, 1), ({"a": 3, None: 1}, 3, 6), ({"b": 9, "a": 10, "é": 2, "": 1}, 2, 3), ({"a": 100, "z": 28, "Z": 27, None: 4}, 3, 2),
])
def test_trees_of_all_shapes(spark, sizes, arity, depth):
    docs = documents(spark, sizes)
    got = verify_rows(docs, keep=["doc_id"], arity=arity, depth=depth, **alter()).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(plain(docs), arity)


def test_more_trees_than_a_block(spark):
    docs = documents(spark, {f"s{i:03}": 1 + i % 4 for i in range(40)}, repeat=True)
    got = verify_rows(docs, keep=["doc_id"], depth=1, **alter()).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(plain(docs))


def test_odd_rows(spark, frame):
    docs = frame(odd_texts()).withColumn("root", F.lit("x")).withColumn("leaf", F.lit("x"))
    made = verify_rows(docs, keep=["doc_id", "root", "leaf"], **alter())
    assert made.columns == ["doc_id", "root", "leaf", "leaf_", "subroot", "root_", "proof_sha256", "folded_root", "verified"]
    got = made.drop("root", "leaf").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(plain(docs))
    empty = verify_rows(docs.limit(0), **alter())
    assert empty.columns[:2] == ["doc_id", "source"] and empty.count() == 0


def test_versions_share_what_they_do_not_copy(spark):
    docs = documents(spark, {"a": 30, "b": 5, None: 1})
    made = build_manifest(docs, depth=2, **alter())
    leaves = {r["_row"]: r for r in made.leaves.collect()}
    groups = {}
    for r in leaves.values():
        groups.setdefault(r.tree, {})[r.pos] = r.digest
    base = {t: raise_all([g[i] for i in range(len(g))], 3) for t, g in groups.items()}
    base[None] = raise_all([base[t][-1][0] for t in sorted(groups)], 3)
    versions = {}
    for r in made.versions().collect():
        versions.setdefault(r.version, []).append(r)
    assert set(versions) == {i for i, r in leaves.items() if r.changed and r.changed != r.digest}
    roots = {r["_row"]: r.folded_root for r in made.proofs().collect()}
    for version, copies in versions.items():
        own = {(r.tree, r.level, r.pos): r.digest for r in copies}
        # One node a level and no more; every copy is the hash of its children, copied or shared.
        assert len(own) == len(copies) == len({(r.tree, r.level) for r in copies})
        for (tree, level, pos), digest in own.items():
            if level:
                below = base[tree][level - 1]
                kids = range(pos * 3, min(pos * 3 + 3, len(below)))
                tops = {k: own.get((tree, level - 1, k)) for k in kids}
                if tree is None and level == 1:
                    tops = {k: own.get((k, len(base[k]) - 1, 0)) for k in kids}
                assert digest == h("".join(tops[k] or below[k] for k in kids))
        assert roots[version] in own.values() and roots[version] != base[None][-1][0]
