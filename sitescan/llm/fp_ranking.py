"""Ranked lexical search over a document FP-tree.

A document is the vector of its terms that some query has, the most frequent first. In that order vectors are
paths of a trie, and documents with equal beginnings share them. Each node knows the largest count of every term
below it and the least length factor, which together bound the score of every document below. A query walks the
trie depth first, best child first, and leaves out whatever can't beat the worst of the best it has.

All counting is over the whole table: term statistics come from Spark. Each task builds tries of its own documents,
a bounded number at a time, and keeps the best of each query so far as the bound for the next trie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitescan.llm.common import free_name, map_batches, slices, stored

BEST = 10
#: Terms of the queries in one pass over the documents; more queries take more passes.
PASS_TERMS = 1 << 16
#: Cells (nodes by terms) of a trie's bounds, and documents under a node that are scored without splitting it.
CELLS, BUCKET, TREE = 1 << 22, 32, 8192
_CUT = 1 << 20
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in runs: letters, digits and everything beyond ASCII; only A-Z is lower-cased."""
    start = 0
    while len(text) - start > _CUT:
        stop = start + _CUT
        while stop < len(text) and _WORDS[text[stop]] != 32:
            stop += 1
        yield text[start:stop].translate(_WORDS).split()
        start = stop
    yield (text[start:] if start else text).translate(_WORDS).split()


def query_terms(queries: DataFrame, text: str, row: str) -> DataFrame:
    """``row, term, times`` of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at=1):
                out = []
                for i, body in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    times: dict[bytes, int] = {}
                    for terms in terms_of(body or b""):
                        for t in terms:
                            times[t] = times.get(t, 0) + 1
                    out += [(i, t.decode(), c) for t, c in times.items()]
                if out:
                    kinds = pa.int64(), pa.string(), pa.int64()
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["row", "term", "times"])

    return map_batches(queries.select(F.col(row).alias("row"), F.col(f"`{text}`")), run, "row bigint, term string, times bigint")


def restricted(docs: DataFrame, doc_id: str, text: str, terms: list[str]) -> DataFrame:
    """``doc, n, terms, counts``: the id of each document, its number of terms, and those of ``terms`` it has.

    ``terms`` holds places in the list, ascending.
    """
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in batches:
            for part in slices(batch, at=1):
                n, found, counts, ends = [], [], [], [0]
                for body in part.column(1).cast(pa.binary()).to_pylist():
                    total, met = 0, []
                    for words in terms_of(body or b""):
                        total += len(words)
                        met.append(np.array([p for p in map(place, words) if p is not None], np.int64))
                    own, times = np.unique(np.concatenate(met), return_counts=True)
                    n.append(total)
                    found.append(own)
                    counts.append(times)
                    ends.append(ends[-1] + len(own))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c), k)) for c, k in ((found, pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], names=["doc", "n", "terms", "counts"])

    source = docs.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`"))
    return map_batches(source, run, "doc bigint, n bigint, terms array<int>, counts array<bigint>")


@dataclass
class Tree:
    """A trie of term vectors, its nodes in depth-first order, documents in the order of their vectors.

    ``first`` and ``last`` delimit the documents under a node and ``end`` its descendants. ``impact`` bounds the
    part of each term's score that doesn't depend on the query.
    """

    first: np.ndarray
    last: np.ndarray
    end: np.ndarray
    impact: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    parts: np.ndarray
    docs: np.ndarray
    absent: np.ndarray


def impact_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def build_tree(vectors: list[np.ndarray], counts: list[np.ndarray], m: np.ndarray, docs: np.ndarray, absent: np.ndarray, width: int, bucket: int = BUCKET) -> Tree:
    """``vectors`` are ascending ranks of terms by frequency, none of them empty."""
    order = sorted(range(len(vectors)), key=lambda i: vectors[i].tolist())
    vectors, counts = [vectors[i] for i in order], [counts[i] for i in order]
    m, docs, absent = m[order], docs[order], absent[order]
    sizes = np.array([len(v) for v in vectors])
    starts = np.concatenate([[0], sizes.cumsum()])
    terms, tf = np.concatenate(vectors), np.concatenate(counts)
    first, last, end, above = [], [], [], []
    # (first and last document, length of the shared path, parent): children are pushed last to first.
    todo = [(0, len(docs), 0, -1)]
    while todo:
        a, b, depth, parent = todo.pop()
        while True:
            # Documents that end here come first in the order; a chain without branches is one node.
            at = starts[a:b] + depth
            head = np.where(depth < sizes[a:b], terms[np.minimum(at, len(terms) - 1)], -1)
            if b - a <= bucket or head[0] != head[-1] or head[0] < 0:
                break
            depth += 1
        own = len(first)
        first.append(a)
        last.append(b)
        above.append(parent)
        if b - a > bucket and head[0] != head[-1]:
            cuts = [*(np.flatnonzero(np.diff(head)) + 1).tolist(), b - a]
            # Branches of a few documents share a leaf; nodes are then at most four a full bucket.
            runs, at = [], 0
            for i, cut in enumerate(cuts):
                if i + 1 == len(cuts) or cuts[i + 1] - at > bucket:
                    runs.append((a + at, a + cut, depth, own))
                    at = cut
            todo += reversed(runs)
    nodes = len(first)
    first, last, above = np.array(first), np.array(last), np.array(above)
    end = np.arange(1, nodes + 1)
    leaf = np.ones(nodes, bool)
    leaf[above[above >= 0]] = False
    most, least = np.zeros((nodes, width), np.int64), np.full(nodes, np.iinfo(np.int64).max)
    leaves = np.flatnonzero(leaf)
    owner = leaves[np.searchsorted(first[leaves], np.arange(len(docs)), side="right") - 1]
    np.maximum.at(most, (np.repeat(owner, sizes), terms), tf)
    np.minimum.at(least, owner, m)
    for node in range(nodes - 1, 0, -1):
        up = above[node]
        np.maximum(most[up], most[node], out=most[up])
        least[up] = min(least[up], least[node])
        end[up] = max(end[up], end[node])
    impact = impact_of(most, least[:, None]).astype(np.int32)
    return Tree(first, last, end, impact, starts, terms, impact_of(tf, np.repeat(m, sizes)), docs, absent)


class Best:
    """The best documents of a query so far: score, then the smaller id; missing ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((0, 3), np.int64)

    @property
    def floor(self) -> int:
        """A score below this can't be among the best; an equal one may, by its id."""
        return int(self.rows[-1, 0]) if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, absent: np.ndarray, docs: np.ndarray) -> None:
        good = scores >= self.floor
        if good.any():
            rows = np.concatenate([self.rows, np.stack([scores[good], absent[good], docs[good]], axis=1)])
            self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]


def search(tree: Tree, terms: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, best: Best) -> int:
    """Depth-first branch and bound; returns the number of nodes whose documents were scored.

    ``weight_of`` is zero but for this query's ``terms``, where it has ``weights``.
    """
    bound = tree.impact[:, terms].astype(np.int64) @ weights
    scored, todo = 0, [0]
    while todo:
        node = todo.pop()
        if bound[node] < best.floor:
            continue
        node_end = int(tree.end[node])
        if node_end == node + 1:
            a, b = int(tree.first[node]), int(tree.last[node])
            low, high = tree.starts[a], tree.starts[b]
            parts = weight_of[tree.terms[low:high]] * tree.parts[low:high]
            best.add(np.add.reduceat(parts, tree.starts[a:b] - low), tree.absent[a:b], tree.docs[a:b])
            scored += 1
            continue
        children, at = [], node + 1
        while at < node_end:
            children.append(at)
            at = int(tree.end[at])
        floor = best.floor
        todo += sorted((c for c in children if bound[c] >= floor), key=bound.__getitem__)
    return scored


def rank_vectors(
    vectors: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], order: np.ndarray, weights: np.ndarray, total: int,
    length: int, best: int, cells: int = CELLS, tree: int = TREE,
) -> DataFrame:
    """``row, doc, score`` of the best documents of each query in each task.

    ``queries`` has (row, terms, times); ``order`` is the rank of each term by frequency and ``weights`` its
    weight; ``total`` documents have ``length`` terms.
    """
    width = len(order)
    most = max(BUCKET, min(tree, cells // max(width, 1) * BUCKET // 4))
    by_rank = np.zeros(width, np.int64)
    by_rank[order] = weights
    asked = [(row, order[t], by_rank[order[t]] * c) for row, t, c in queries]
    shared = vectors.sparkSession.sparkContext.broadcast((asked, order, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, order, width = shared.value
        found = {row: Best(best) for row, _, _ in asked}
        weight_of = np.zeros(width, np.int64)

        def work(held: list) -> None:
            docs = np.array([h[0] or 0 for h in held], np.int64)
            absent = np.array([h[0] is None for h in held], np.int64)
            n = np.array([h[1] for h in held], np.int64)
            # 75 n N may pass 64 bits; the quotient doesn't.
            m = np.array([25 + 75 * int(x) * total // length for x in n], np.int64)
            made = build_tree([h[2] for h in held], [h[3] for h in held], m, docs, absent, width)
            for row, terms, values in asked:
                weight_of[terms] = values
                search(made, terms, values, weight_of, found[row])
                weight_of[terms] = 0

        held: list = []
        for batch in batches:
            terms, counts = batch.column(2), batch.column(3)
            ends, flat, times = np.asarray(terms.offsets), np.asarray(terms.values), np.asarray(counts.values)
            for i, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = order[flat[ends[i]:ends[i + 1]]]
                by = np.argsort(own)
                held.append((doc, n, own[by], times[ends[i]:ends[i + 1]][by]))
                if len(held) == most:
                    work(held)
                    held = []
        if held:
            work(held)
        for row, top in found.items():
            if len(top.rows):
                score, absent, doc = top.rows.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), row)), pa.array(doc, mask=absent.astype(bool)), pa.array(score)],
                    names=["row", "doc", "score"],
                )

    return map_batches(vectors, run, "row bigint, doc bigint, score bigint")


def top_of(rows: DataFrame, best: int) -> DataFrame:
    """``row, doc, score, rank``: the best of each query; first among a 64th of the tasks, then of all."""
    order = F.col("score").desc(), F.col("doc").asc_nulls_last()
    spread = rows.withColumn("_some", F.spark_partition_id() % 64)
    for keys in (["row", "_some"], ["row"]):
        spread = spread.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    return spread.drop("_some")


def rank_documents(
    docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_text: str = "text",
    best: int = BEST, pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """The rows of ``queries`` with ``rank, doc_id, score`` added, one row for each document ranked.

    Weight of a term: floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums, over the query's terms with
    repeats, weight * (1e9 tf div (1000 tf + 8 m)) with m = 25 + (75 n N div L). Only scores above 0 are ranked;
    equal ones by ascending id, missing ids last. N counts documents with a term, L all terms.

    Queries are taken in passes of about ``pass_terms`` query terms, so what goes to the driver and the tasks is
    bounded; one query is never split. Missing texts have no terms, a query without terms has no rows, repeated
    documents are ranked each, repeated queries too, and empty tables give no rows. Clashing names get an
    underscore.
    """
    row = free_name(queries, "_query")
    asked = stored(queries.withColumn(row, F.monotonically_increasing_id()))
    terms = stored(query_terms(asked, query_text, row))
    passes = terms.count() // pass_terms + 1
    found = None
    for now in range(passes):
        chosen = terms if passes == 1 else terms.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == now)
        made = rank_pass(docs, chosen, doc_id, text, best)
        if made is not None:
            found = made if found is None else found.unionByName(made)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "row bigint, doc bigint, score bigint, rank int")
    names = [free_name(queries, c) for c in ("rank", doc_id, "score")]
    packed = asked.select(F.col(row).alias("_asked"), F.struct(*[F.col(f"`{c}`") for c in queries.columns]).alias("_own"))
    ranked = found.select("row", F.struct("rank", "doc", "score").alias("_found"))
    return packed.join(ranked, F.col("_asked") == F.col("row")).select(
        F.col("_own.*"), *[F.col(f"_found.{c}").alias(n) for c, n in zip(("rank", "doc", "score"), names)]
    )


def rank_pass(docs: DataFrame, terms: DataFrame, doc_id: str, text: str, best: int) -> DataFrame | None:
    """One pass over the documents for some queries; None if they have no terms or no document has any."""
    rows = terms.collect()
    names = sorted({r["term"] for r in rows})
    if not names:
        return None
    vectors = stored(restricted(docs, doc_id, text, names))
    total, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return None
    df = np.zeros(len(names), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["t"]] = r["df"]
    order = np.empty(len(names), np.int64)
    order[np.lexsort((np.arange(len(names)), -df))] = np.arange(len(names))
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    place, asked = {t: i for i, t in enumerate(names)}, {}
    for r in rows:
        asked.setdefault(r["row"], []).append((place[r["term"]], r["times"]))
    queries = [(q, *(np.array(c, np.int64) for c in zip(*sorted(pairs)))) for q, pairs in sorted(asked.items())]
    some = vectors.where(F.size("terms") > 0)
    return top_of(rank_vectors(some, queries, order, weights, total, length, best), best)
