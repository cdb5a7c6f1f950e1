"""SimHash near-duplicates by vantage-point trees.

Distinct fingerprints only: a group of exact copies is one of them. A tree of vantage points, fitted to a
bounded sample, cuts the Hamming space into shells by distance; its leaves are the shards. Each fingerprint
lives in one shard and is sent as a query to the shards that its ball overlaps by the triangle inequality.
Inside a shard the same pruning goes on with further vantage points down to small blocks that are compared
directly. The search is exact whatever the tree; the sample only decides how even the shards are.

Two fingerprints with the same number of bits modulo 2 differ by an even number of bits, others by an odd one,
so each of the two classes has a tree of its own, searched with the largest radius of the right parity.

A shard gives the spanning stars of its links, never all its pairs; connected components come from rounds of
large-star and small-star steps over stored edge tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescan.llm.common import columns_of, free_name, map_batches, map_texts, runs, stored

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints a shard should hold, and the most that are sampled to fit the tree (8 bytes each).
SHARD = 2048
SAMPLE = 200_000
#: Comparisons that are made directly, without another vantage point.
BLOCK = 1 << 19


def simhash(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in more than half the hashes of the word shingles; 0 without words. Signed 64 bits."""
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(s, seed) for s in shingles], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(0, dtype=np.uint32) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the 64-bit SimHash of each text; a missing text counts as empty."""

    def kernel():
        return lambda texts: {"fp": [simhash((t or b"").lower().split()) for t in texts]}

    own = F.struct(*columns_of(docs)).alias("_row")
    made = map_texts(docs, [own], F.col(f"`{text}`").cast("binary"), kernel, "fp bigint")
    return made.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], F.col("fp").alias(name))


# --- the tree ---------------------------------------------------------------------------------------------

def distances(points: np.ndarray, to: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((points ^ to).view(np.uint64)).astype(np.int16)


def grow(points: np.ndarray, leaf: int, leaves: list[int], depth: int = 0) -> Any:
    """A leaf's number, or (vantage point, [(low, high, child)]) with ranges that cover all distances.

    Of a few candidates from the points the one with the widest spread of distances is taken. Adjacent shells
    are put together while they hold few points.
    """
    if len(points) > leaf and depth < 24:
        tries = points[np.linspace(0, len(points) - 1, 8).astype(int)]
        far = [distances(points, t) for t in tries]
        best = max(range(len(tries)), key=lambda i: (far[i].std(), -i))
        counts = np.bincount(far[best], minlength=65)
        cuts, held = [], 0
        for d in range(65):
            held += counts[d]
            if held * 2 > leaf and counts[d + 1:].sum() * 2 > leaf:
                cuts.append(d)
                held = 0
        if cuts:
            ranges = list(zip([0, *(c + 1 for c in cuts)], [*cuts, 64]))
            children = []
            for low, high in ranges:
                inside = points[(far[best] >= low) & (far[best] <= high)]
                children.append((low, high, grow(inside, leaf, leaves, depth + 1)))
            return int(tries[best]), children
    leaves.append(len(points))
    return len(leaves) - 1


def route(node: Any, points: np.ndarray, rows: np.ndarray, radius: int, out: list) -> None:
    """Appends (leaf, rows) for the leaves that the balls of ``radius`` around ``points[rows]`` overlap."""
    if not len(rows):
        return
    if isinstance(node, int):
        out.append((node, rows))
        return
    far = distances(points[rows], np.int64(node[0]))
    for low, high, child in node[1]:
        route(child, points, rows[(far >= low - radius) & (far <= high + radius)], radius, out)


def parity(points: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points.view(np.uint64)) & 1


def fit_forest(sample: np.ndarray, total: int, shard: int) -> list:
    """A tree for each parity, leaves numbered through."""
    leaf = max(8, shard * len(sample) // max(total, 1))
    sample, leaves = np.sort(sample), []
    return [grow(sample[parity(sample) == p], leaf, leaves) for p in (0, 1)]


def addresses(points: np.ndarray, forest: list, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, query, row): the home of each point, and the later leaves its ball overlaps.

    Of two points in different shards the one that lives earlier is sent to the other, so that each pair meets
    once.
    """
    own, home = parity(points), np.zeros(len(points), np.int64)
    parts = []
    for p in (0, 1):
        found: list = []
        route(forest[p], points, np.flatnonzero(own == p), 0, found)
        for leaf, rows in found:
            home[rows] = leaf
            parts.append((np.full(len(rows), leaf), np.zeros(len(rows), bool), rows))
    for p in (0, 1):
        for q in (0, 1):
            reach = radius - (radius % 2 != (p != q))
            if reach < 0:
                continue
            found = []
            route(forest[q], points, np.flatnonzero(own == p), reach, found)
            for leaf, rows in found:
                rows = rows[home[rows] < leaf]
                parts.append((np.full(len(rows), leaf), np.ones(len(rows), bool), rows))
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
    return columns[0], columns[1].astype(bool), columns[2]


class Links:
    """Which points hang together; pairs are folded in block by block and not kept."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        new = a != b
        if new.any():
            self.root = stars(len(self.root), a[new], b[new])[self.root]


def stars(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable node of each node."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def join_close(points: np.ndarray, h: np.ndarray, q: np.ndarray, radius: int, links: Links) -> None:
    """Links the points ``q`` with the points ``h`` within ``radius``, pruned by vantage points of the shard."""
    if not len(h) or not len(q):
        return
    if len(h) * len(q) > BLOCK and len(h) > 32:
        point = points[h[len(h) // 2]]
        far_h, far_q = distances(points[h], point), distances(points[q], point)
        shells = np.unique(far_h)
        if len(shells) > 1:
            for d in shells:
                join_close(points, h[far_h == d], q[np.abs(far_q - d) <= radius], radius, links)
            return
    step = max(1, BLOCK // len(h))
    for at in range(0, len(q), step):
        block = q[at:at + step]
        a, b = np.nonzero(np.bitwise_count((points[block][:, None] ^ points[h][None, :]).view(np.uint64)) <= radius)
        links.add(block[a], h[b])


def shard_links(home: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (fingerprint, smallest fingerprint) of the links of a shard with itself and its queries."""
    points = np.concatenate([home, queries])
    own, links = np.arange(len(home)), Links(len(points))
    join_close(points, own, own, radius, links)
    same = np.append(np.zeros(len(home), bool), parity(queries) == parity(home[:1])[0])
    other = np.append(np.zeros(len(home), bool), ~same[len(home):])
    join_close(points, own, np.flatnonzero(same), radius - radius % 2, links)
    join_close(points, own, np.flatnonzero(other), radius - 1 + radius % 2, links)
    low = np.full(len(points), np.iinfo(np.int64).max)
    np.minimum.at(low, links.root, points)
    root = low[links.root]
    moved = root != points
    return points[moved], root[moved]


def link_fingerprints(unique: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Edges ``a, b`` (a > b) that connect exactly what links of ``radius`` bits or fewer connect.

    ``unique`` has one column, ``fp``, of distinct values.
    """
    total = unique.count()
    share = min(1.0, sample / max(total, 1))
    drawn = unique.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)))
    points = np.array([r[0] for r in drawn.collect()], dtype=np.int64)
    shared = unique.sparkSession.sparkContext.broadcast(fit_forest(points, total, shard))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            leaf, query, rows = addresses(fps, shared.value, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf.astype(np.int32)), pa.array(query), pa.array(fps[rows])], names=["leaf", "query", "fp"]
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (query, fps) in runs(batches):
            if not query.all():
                a, b = shard_links(fps[~query], fps[query], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sent = map_batches(unique.select("fp"), send, "leaf int, query boolean, fp bigint")
    together = sent.repartition("leaf").sortWithinPartitions("leaf")
    return map_batches(together, search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for each node of the edges ``a, b`` the smallest node it is connected with.

    Rounds of large-star and small-star until only stars are left. Minima are combined before the shuffle, and
    the join that hands them out has one row a node on one side, so a hub can be split.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # In a star every edge leads from a node with no other edge to one that leads nowhere.
        ends = now.select(F.explode(F.array(
            F.struct(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")),
        )).alias("e")).groupBy("e.u").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if ends.where("up > 1 or up = 1 and down = 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(large.where("a <> b").distinct())
        low = now.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = now.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b")
        now = stored(small.where("a <> b").distinct())


def _classes(rows: DataFrame, doc_id: str, fp: str, radius: int) -> DataFrame:
    """``_fp, root, component_id`` for each distinct fingerprint."""
    unique = stored(rows.groupBy(F.col(f"`{fp}`").alias("fp")).agg(F.min(F.col(f"`{doc_id}`")).alias("first")))
    roots = components(link_fingerprints(unique.select("fp"), radius))
    linked = unique.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = linked.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id"))
    return linked.join(named, F.col("root") == F.col("_root")).select(
        F.col("fp").alias("_fp"), "root", "component_id"
    )


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicate_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, keep: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with ``fingerprint`` (16 hex digits) and ``component_id`` added.

    ``keep`` names the columns to return (all by default); others, a text above all, are then not stored.

    ``component_id`` is the smallest id among the rows reachable over links. Texts without words, missing ones
    included, have fingerprint zero and are linked like any other. Rows that repeat share a class; a missing
    id is never the smallest, and a class of such rows alone has none. Names that clash get an underscore.
    """
    fp, names = free_name(docs, "fp"), {c: free_name(docs, c) for c in ("fingerprint", "component_id")}
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    narrow = kept if keep is None or doc_id in keep else [F.col(f"`{doc_id}`"), *kept]
    marked = stored(with_fingerprint(docs, text, fp).select(*narrow, F.col(f"`{fp}`")))
    classes = _classes(marked, doc_id, fp, radius).select("_fp", F.col("component_id").alias("_component"))
    return marked.join(classes, F.col(f"`{fp}`") == F.col("_fp")).select(
        *kept, hex_of(F.col(f"`{fp}`")).alias(names["fingerprint"]),
        F.col("_component").alias(names["component_id"]),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each class: the smallest id, of rows that share it any one; rows without id come last."""
    fp, row = free_name(docs, "fp"), free_name(docs, "row")
    marked = stored(with_fingerprint(docs, text, fp).withColumn(row, F.monotonically_increasing_id()))
    return first_of_each(marked, _classes(marked, doc_id, fp, radius), doc_id, fp, row).select(*columns_of(docs))


def first_of_each(marked: DataFrame, classes: DataFrame, doc_id: str, fp: str, row: str) -> DataFrame:
    """The rows of ``marked`` that stay; ``classes`` has ``_fp, root``, ``row`` numbers the rows."""
    classes, own = classes.select("_fp", "root"), F.col(f"`{doc_id}`")
    narrow = marked.select(F.struct(own.isNull().alias("n"), own.alias("i"), F.col(f"`{row}`").alias("r")).alias("k"), F.col(f"`{fp}`").alias("f"))
    kept = narrow.join(classes, F.col("f") == F.col("_fp")).groupBy("root").agg(F.min("k").alias("k"))
    kept = kept.select(F.col("k.r").alias("_kept"))
    return marked.join(kept, F.col(f"`{row}`") == F.col("_kept"))
