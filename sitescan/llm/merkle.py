"""A manifest of a dataset as a persistent Merkle tree.

Every row is a leaf; rows of one group make a tree, and the roots of these trees make the tree above. A node is
the SHA-256 of its children's digests. Nodes are never changed: a tampered leaf creates a version, which copies
only the nodes on the path to the root and shares all others with the first version.

Trees are built in aligned blocks of ``ARITY ** DEPTH`` nodes. A block is the largest thing a task holds; its top
is a node of the next round's blocks, so a round divides the number of nodes by the size of a block. Paths come
back down the same way: a block hands its own path to the nodes in it, so no join meets more than one block's
nodes at one key, however large a group is. Versions copy their ancestors inside their block and go on along the
path the block was handed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitescan.llm.common import free_name, kernel_types, map_batches, stored
from sitescan.operators.ordering import with_ordinal

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, DEPTH = 3, 6
_PATH = "array<struct<left:string,right:string>>"


def content_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field as ``-`` if missing, else its UTF-8 length, a colon and its text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height_of(nodes: int, arity: int) -> int:
    """Levels above the leaves of a whole tree."""
    return levels_of(nodes, arity, nodes)


def levels_of(nodes: int, arity: int, depth: int) -> int:
    """Levels that a block of a tree with so many nodes rises: all, or up to the root."""
    up = 0
    while nodes > 1 and up < depth:
        nodes, up = -(-nodes // arity), up + 1
    return up


def raised(digests: list[str], levels: int, arity: int) -> list[list[str]]:
    """The nodes of a block, level by level, its own nodes first."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([joined(below[i:i + arity]) for i in range(0, len(below), arity)])
    return out


def siblings(levels: list[list[str]], at: int, arity: int) -> Iterator[tuple[str, str]]:
    """For each level of a block: the digests left and right of the node's ancestor in its run."""
    for nodes in levels[:-1]:
        first = at - at % arity
        yield "".join(nodes[first:at]), "".join(nodes[at + 1:first + arity])
        at //= arity


def copied(digest: str, path: list[tuple[str, str]]) -> list[str]:
    """New ancestors of a changed node, up to the root."""
    out = []
    for left, right in path:
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
        out.append(digest)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each (tree, block), which lie next to each other; the first two columns name it."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != now:
                if held:
                    yield now, held
                now, held = row[:2], []
            held.append(row[2:])
    if held:
        yield now, held


def _together(df: DataFrame) -> DataFrame:
    return df.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def raise_blocks(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """``tree, pos, n, digest`` of the tops of the blocks of ``nodes``, which has the same columns.

    ``pos`` counts the nodes of a tree from 0, ``n`` is their number.
    """
    size = arity ** depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in _blocks(batches):
            n = rows[0][1]
            top, = raised([r[2] for r in rows], levels_of(n, arity, depth), arity)[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in ((tree, pa.int64()), (block, pa.int64()), (-(-n // size), pa.int64()), (top, pa.string()))],
                names=["tree", "pos", "n", "digest"],
            )

    placed = nodes.select("tree", F.expr(f"pos div {size}").alias("block"), "pos", "n", "digest")
    return map_batches(_together(placed), run, "tree bigint, pos bigint, n bigint, digest string")


def _handed(nodes: DataFrame, paths: DataFrame, extra: list[str], size: int) -> DataFrame:
    """Nodes in their blocks, each block led by one row that carries its path."""
    none = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in extra]
    heads = paths.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("digest"), *none, "path")
    own = nodes.select("tree", F.expr(f"pos div {size}").alias("block"), "pos", "n", "digest", *extra, F.lit(None).cast(_PATH).alias("path"))
    return _together(own.unionByName(heads))


def _led(batches: Iterator[pa.RecordBatch], arity: int, depth: int) -> Iterator[tuple[tuple, list, list, list]]:
    """(tree and block, its path, its rows, its levels) for the blocks of :func:`_handed`."""
    for key, rows in _blocks(batches):
        head, rows = rows[0], rows[1:]
        path = [(p["left"], p["right"]) for p in head[-1]]
        yield key, path, rows, raised([r[2] for r in rows], levels_of(rows[0][1], arity, depth), arity)


def hand_down(nodes: DataFrame, paths: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """``tree, pos, path`` of every node, from the ``tree, pos, path`` of the blocks' tops.

    A path has the digests left and right of each ancestor in its run, from the node's own level to the root.
    """
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), path, rows, levels in _led(batches, arity, depth):
            own = [
                [{"left": a, "right": b} for a, b in [*siblings(levels, i, arity), *path]] for i in range(len(rows))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array(own, kind)],
                names=["tree", "pos", "path"],
            )

    return map_batches(_handed(nodes, paths, [], arity ** depth), run, f"tree bigint, pos bigint, path {_PATH}")


@dataclass
class Rounds:
    """Trees over some nodes: the nodes of each round, and ``tree, digest`` of the roots."""

    nodes: list[DataFrame]
    roots: DataFrame

    def paths(self, above: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
        """``tree, pos, path`` of the first round's block tops, from the ``tree, path`` of the roots."""
        # A tree's root is the only node of its last round, and no later round has it.
        roots = above.select("tree", F.lit(0).cast("bigint").alias("pos"), "path")
        now = None
        for nodes in reversed(self.nodes[1:]):
            ended = nodes.where("n = 1").select("tree").join(roots, "tree").select("tree", "pos", "path")
            alive = nodes.where("n > 1")
            now = stored(ended if now is None else ended.unionByName(hand_down(alive, now, arity, depth)))
        return now


def build_trees(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> Rounds:
    """Rounds of blocks until every tree of ``tree, pos, n, digest`` is one node."""
    rounds = [nodes]
    alive, roots = nodes, None
    while True:
        tops = stored(raise_blocks(alive, arity, depth))
        rounds.append(tops)
        done = tops.where("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        alive = tops.where("n > 1")
        if alive.isEmpty():
            return Rounds(rounds, roots)


@dataclass
class Manifest:
    """Leaves, the trees of the groups and the tree of their roots.

    ``leaves`` has ``tree, pos, n, digest, _row, changed``: ``changed`` is the leaf of the altered row, missing
    where nothing was altered. ``rows`` has the kept columns as ``_k0, _k1, ...`` and ``_row``.
    """

    rows: DataFrame
    leaves: DataFrame
    trees: Rounds
    top: Rounds
    kept: list[str]
    arity: int = ARITY
    depth: int = DEPTH

    @property
    def root(self) -> DataFrame:
        """One row ``root``, none for an empty dataset."""
        return self.top.roots.select(F.col("digest").alias("root"))

    def block_paths(self) -> DataFrame:
        """``tree, pos, path`` of the blocks of leaves, through the tree's root to the root of all."""
        size = self.arity, self.depth
        none = self.top.roots.select("tree", F.array().cast(_PATH).alias("path"))
        over = hand_down(self.top.nodes[0], self.top.paths(none, *size), *size)
        return self.trees.paths(over.select(F.col("pos").alias("tree"), "path"), *size)

    def _walked(self, make: Callable, schema: str) -> DataFrame:
        """What ``make`` gives out for each leaf: (row, tree, pos, n, leaf, altered leaf, path to the root)."""
        arity, depth, kinds = self.arity, self.depth, kernel_types(self.leaves.sparkSession, schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (tree, _), path, rows, levels in _led(batches, arity, depth):
                out = []
                for i, (pos, n, digest, row, changed, _) in enumerate(rows):
                    out += make(row, tree, pos, n, digest, changed, [*siblings(levels, i, arity), *path])
                if out:
                    arrays = [pa.array(values, kind) for values, (_, kind) in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in kinds])

        leaves = self.leaves.select("tree", "pos", "n", "digest", "_row", "changed")
        return map_batches(_handed(leaves, self.block_paths(), ["_row", "changed"], arity ** depth), run, schema)

    def proofs(self) -> DataFrame:
        """``_row, subroot, proof_sha256, folded_root`` of every leaf.

        The folded root is the root of the leaf's version: the altered leaf, or the leaf itself, with its path
        copied up to the root.
        """
        arity = self.arity

        def make(row, tree, pos, n, digest, changed, path):
            proof = sha256("".join([a + b for a, b in path]).encode()).hexdigest()
            own = [digest, *copied(digest, path)]
            new = own if changed is None or changed == digest else [changed, *copied(changed, path)]
            return [(row, own[height_of(n, arity)], proof, new[-1])]

        return self._walked(make, "_row bigint, subroot string, proof_sha256 string, folded_root string")

    def versions(self) -> DataFrame:
        """``version, tree, level, pos, digest``: the nodes that each altered leaf's version has of its own.

        The leaf is level 0 of its tree; above the tree's root the version goes on in the tree of roots, whose
        ``tree`` is missing here. All other nodes are those of the first version.
        """
        arity = self.arity

        def make(row, tree, pos, n, digest, changed, path):
            if changed is None or changed == digest:
                return []
            height, out = height_of(n, arity), []
            for level, made in enumerate([changed, *copied(changed, path)]):
                over = level - height
                at = (tree, level, pos // arity ** level) if over <= 0 else (None, over, tree // arity ** over)
                out.append((row, *at, made))
            return out

        return self._walked(make, "version bigint, tree bigint, level int, pos bigint, digest string")


def build_manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id",
    altered: dict[str, Column] | None = None, where: Column | None = None, keep: list[str] | None = None,
    arity: int = ARITY, depth: int = DEPTH,
) -> Manifest:
    """The manifest of ``docs``: a leaf of ``fields`` for each row, a tree for each value of ``group``.

    Leaves ascend by ``order``, missing values first; rows that share it by their digest, and equal rows are
    leaves of their own. Groups ascend by the bytes of their name, a missing one first. ``altered`` names fields
    and what was made of them in the rows of ``where`` (all by default); a missing value stays missing.
    """
    kept = list(dict.fromkeys([order, group])) if keep is None else list(keep)
    digest = content_digest([F.col(f"`{f}`") for f in fields])
    changed = F.lit(None).cast("string")
    if altered:
        made = content_digest([altered.get(f, F.col(f"`{f}`")) for f in fields])
        changed = made if where is None else F.when(where, made)
    base = stored(docs.select(
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(kept)], F.col(f"`{group}`").alias("_group"),
        F.col(f"`{order}`").alias("_order"), digest.alias("digest"), changed.alias("changed"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    # Sorted by range, so that a hot group is spread over partitions and counted partition by partition.
    key = [F.col("_group").asc_nulls_first(), F.col("_order").asc_nulls_first(), F.col("digest"), F.col("_row")]
    narrow = base.select("_group", "_order", "digest", "changed", "_row")
    ranged = stored(
        narrow.repartitionByRange(*key).sortWithinPartitions(*key).drop("_order")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    pieces = ranged.groupBy("_group", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    same = Window.partitionBy("_group")
    before = same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored(pieces.select(
        "_group", "_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(same).alias("_n"),
    ))
    # A group's first row is in its first piece; the groups lie in the order of these.
    groups = stored(with_ordinal(pieces.where("_before = 0").select("_group", "_first"), "_first", "_tree"))
    pieces = pieces.join(groups.select(F.col("_group").alias("_g"), "_tree"), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    pieces = pieces.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), "_first", "_before", "_n", "_tree")
    placed = ranged.join(pieces, F.col("_group").eqNullSafe(F.col("_g")) & (part == F.col("_p")))
    leaves = stored(placed.select(
        F.col("_tree").alias("tree"), (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"),
        F.col("_n").alias("n"), "digest", "_row", "changed",
    ))
    trees = build_trees(leaves.select("tree", "pos", "n", "digest"), arity, depth)
    many = groups.count()
    roots = stored(trees.roots.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(many).cast("bigint").alias("n"), "digest"
    ))
    top = build_trees(roots, arity, depth)
    return Manifest(base, leaves, trees, top, kept, arity, depth)


def verify_rows(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id",
    altered: dict[str, Column] | None = None, where: Column | None = None, keep: list[str] | None = None,
    arity: int = ARITY, depth: int = DEPTH,
) -> DataFrame:
    """The ``keep`` columns of every row with ``leaf, subroot, root, proof_sha256, folded_root, verified`` added.

    All but ``folded_root`` describe the first version; ``folded_root`` is the root of the version made by the
    row's altered leaf, and ``verified`` tells whether it is still the root. See :func:`build_manifest` for missing
    values and repeated rows; an empty table gives no rows. Names that clash get an underscore.
    """
    made = build_manifest(docs, fields, group, order, altered, where, keep, arity, depth)
    kept = docs.select(*[F.col(f"`{c}`") for c in made.kept])
    names = [free_name(kept, c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]
    top = made.root.first()
    root = F.lit(top[0] if top else None).cast("string")
    full = made.rows.join(made.proofs().withColumnRenamed("_row", "_proved"), F.col("_row") == F.col("_proved"))
    values = ["digest", "subroot", root, "proof_sha256", "folded_root", F.col("folded_root") == root]
    return full.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(made.kept)],
        *[(F.col(v) if isinstance(v, str) else v).alias(n) for v, n in zip(values, names)],
    )
