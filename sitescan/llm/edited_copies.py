"""Edited copies: word sequences whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

An exact prefix-filter join. Shingles met in one word sequence only can't be shared, so the others and the
number of all shingles decide. A sequence's shingles are taken the rarest first, those of no other sequence
before all; a pair that is similar shares one among the first fifth of the longer sequence (which probes) and
the first ninth of the shorter one (which is indexed), and from there on both have enough shingles left. Texts
that differ in more than that, such as letters of one form, are then no candidates, however much they share.

Postings are packed arrays of 48-bit hashes, dealt by hash. Shingles of very many sequences, as a bounded sample
of them shows, are last in the order and go straight to their sequence, so no part holds all postings of one of
them; the sample only decides the order, and any order gives the same pairs. Candidates are verified by their
whole sets of hashes.

Many copies of one text would meet in all pairs. Only pairs of different classes are compared, and while these
are many, each bucket is first compared with one sequence of its largest class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.llm.common import columns_of, free_name, map_batches, map_column, runs, slices, stored
from sitescan.llm.near_duplicates import RADIUS, components, first_of_each, link_fingerprints, simhash

WORDS = 5
#: Least similarity as a fraction, so that no rounding decides.
SIMILAR = (4, 5)
#: Postings one task should sort, and pairs a posting that are compared without another round.
POSTINGS, PAIRS = 1 << 20, 4
#: Sequences sampled for frequent shingles, how many of them must share one, and how many such are sent to tasks.
SAMPLE, FREQUENT, FREQUENT_MOST = 16_384, 12, 1 << 17

_MIX = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64 for i in range(1, 65)], dtype=np.uint64)
_BYTES = 6
_PACKED = "part int, docs binary, many binary, hashes binary, met binary"


def shingle_hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the runs of ``size`` words, none for fewer words."""
    if len(words) < size:
        return np.zeros(0, np.int64)
    one = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    hashed = np.array([one[w] for w in words], dtype=np.uint64)
    last = len(words) - size + 1
    mixed = sum(hashed[i:i + last] * _MIX[i] for i in range(size))
    return np.unique(((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(16)).view(np.int64))


def packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    return out.reshape(-1).view("<i8")


def _dealt(part: np.ndarray, docs: np.ndarray, hashes: np.ndarray, met: np.ndarray | None) -> pa.RecordBatch:
    """One row a part with its postings: each sequence named once with how many hashes follow for it."""
    order = np.lexsort((hashes, docs, part))
    part, docs, hashes = part[order], docs[order], hashes[order]
    met = None if met is None else met[order].astype(np.int32)
    named = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (docs[1:] != docs[:-1]))) if len(part) else np.zeros(0, np.int64)
    many = np.diff(np.append(named, len(part))).astype(np.int32)
    heads, names = part[named], docs[named]
    outer = np.flatnonzero(np.append(True, heads[1:] != heads[:-1])) if len(heads) else np.zeros(0, np.int64)
    ends = np.append(outer, len(heads))
    rows = [(a, b, named[a], named[b] if b < len(named) else len(part)) for a, b in zip(ends, ends[1:])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(heads[outer].astype(np.int32), pa.int32()),
            pa.array([names[a:b].tobytes() for a, b, _, _ in rows], pa.binary()),
            pa.array([many[a:b].tobytes() for a, b, _, _ in rows], pa.binary()),
            pa.array([packed(hashes[c:d]) for _, _, c, d in rows], pa.binary()),
            pa.array([None if met is None else met[c:d].tobytes() for _, _, c, d in rows], pa.binary()),
        ],
        names=["part", "docs", "many", "hashes", "met"],
    )


def _postings(docs, many, hashes) -> tuple[np.ndarray, np.ndarray]:
    """(sequences, hashes) of the rows of a part, one for each posting."""
    names = np.frombuffer(b"".join(docs), np.int64)
    return np.repeat(names, np.frombuffer(b"".join(many), np.int32)), unpacked(b"".join(hashes))


def frequent_shingles(texts: DataFrame, size: int = WORDS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, estimated number of sequences) of shingles that many sequences share, from a bounded sample."""
    total = texts.count()
    share = min(1.0, sample / max(total, 1))
    drawn = texts.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1 << 20):
                found = dict(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()))
                sets = [shingle_hashes((t or b"").lower().split(), size) for t in found.values()]
                hashes, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n)], names=["h", "n"])

    met = map_batches(drawn, run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = sorted((r["h"], r["n"]) for r in met.orderBy(F.col("n").desc(), "h").limit(FREQUENT_MOST).collect())
    hashes, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
    return hashes, np.minimum(n / max(share, 1e-12), 2**31 - 1).astype(np.int64)


def shingle_sets(texts: DataFrame, total: int, size: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``doc, n, before, prefix, indexed, hashes`` of the word sequences that may have a partner.

    ``texts`` has ``doc``, the digest of the word sequence, and ``_text``, its bytes; ``total`` is about the number
    of words in all. ``n`` counts all shingles, ``before`` those met nowhere else, ``hashes`` packs the others and
    ``prefix`` is the rarest of them, the first ``indexed`` of which a shorter partner shares one of.
    """
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // POSTINGS + 1)
    top, base = similar
    shared = spark.sparkContext.broadcast(frequent_shingles(texts, size))

    def part_of(values: np.ndarray) -> np.ndarray:
        return ((values.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, estimate = shared.value
        for batch in batches:
            for piece in slices(batch, 1 << 20):
                found = dict(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()))
                sets = {d: shingle_hashes((t or b"").lower().split(), size) for d, t in found.items()}
                sets = {d: s for d, s in sets.items() if len(s)}
                if not sets:
                    continue
                docs, sizes = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int64)
                hashes, held = np.concatenate(list(sets.values())), np.repeat(docs, sizes)
                place = np.minimum(np.searchsorted(often, hashes), max(len(often) - 1, 0))
                hot = often[place] == hashes if len(often) else np.zeros(len(hashes), bool)
                yield _dealt(part_of(hashes[~hot]), held[~hot], hashes[~hot], None)
                # Frequent ones pass the next step as they are, with the sizes (as hash -1): their parts are negative.
                yield _dealt(
                    -1 - part_of(np.concatenate([held[hot], docs])), np.concatenate([held[hot], docs]),
                    np.concatenate([hashes[hot], np.full(len(docs), _SIZE)]), np.concatenate([estimate[place[hot]], sizes]),
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (docs, many, hashes, met) in runs(batches):
            if part < 0:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), -1 - part, np.int32)), *(pa.array(c, pa.binary()) for c in (docs, many, hashes, met))],
                    names=["part", "docs", "many", "hashes", "met"],
                )
                continue
            held, hashes = _postings(docs, many, hashes)
            order = np.lexsort((held, hashes))
            held, hashes = held[order], hashes[order]
            new = np.append(True, (held[1:] != held[:-1]) | (hashes[1:] != hashes[:-1]))
            held, hashes = held[new], hashes[new]
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            n = np.diff(np.append(first, len(hashes)))
            n = np.repeat(n, n)
            some = n > 1
            if some.any():
                yield _dealt(part_of(held[some]), held[some], hashes[some], n[some])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (docs, many, hashes, met) in runs(batches):
            held, hashes = _postings(docs, many, hashes)
            met = np.frombuffer(b"".join(met), np.int32).astype(np.int64)
            # The size first, then the rarest shingles; a sequence that comes twice is counted once.
            order = np.lexsort((hashes, np.where(hashes == _SIZE, -1, met), held))
            held, hashes, met = held[order], hashes[order], met[order]
            new = np.append(True, (held[1:] != held[:-1]) | (hashes[1:] != hashes[:-1]))
            held, hashes, met = held[new], hashes[new], met[new]
            cuts = np.append(np.flatnonzero(np.append(True, held[1:] != held[:-1])), len(held))
            made = []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                n, before = int(met[a]), int(met[a]) - (b - a - 1)
                probes = n - -(-n * top // base) + 1 - before
                if probes > 0:
                    indexed = n - -(-2 * n * top // (top + base)) + 1 - before
                    made.append((
                        int(held[a]), n, before, hashes[a + 1:a + 1 + probes], max(indexed, 0), packed(np.sort(hashes[a + 1:b])),
                    ))
            if made:
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["doc", "n", "before", "prefix", "indexed", "hashes"]
                )

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("part")

    counted = map_batches(dealt(map_batches(texts, post, _PACKED)), count, _PACKED)
    return map_batches(
        dealt(counted), gather, "doc bigint, n bigint, before bigint, prefix array<bigint>, indexed bigint, hashes binary"
    )


#: Marks the size of a sequence among its hashes, which have 48 bits; packed, it keeps them all set.
_SIZE = (1 << 48) - 1


def verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The class pairs ``a, b`` of the similar ones among the pairs ``x, y`` of sequences."""
    top, base = similar
    one = sets.select(F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("hashes").alias("hx"))
    two = sets.select(F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("hashes").alias("hy"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, nx, ny, hx, hy = (c.to_pylist() for c in batch.columns)
            good = []
            for i, (p, q) in enumerate(zip(hx, hy)):
                both = len(np.intersect1d(unpacked(p), unpacked(q), assume_unique=True))
                if base * both >= top * (nx[i] + ny[i] - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[i] for i in good], pa.int64()) for c in (a, b)], names=["a", "b"]
            )

    wide = pairs.join(one, "x").join(two, "y").select("a", "b", "nx", "ny", "hx", "hy")
    return map_batches(wide, compare, "a bigint, b bigint").distinct()


def link_copies(
    texts: DataFrame, classes: DataFrame, total: int, size: int = WORDS, similar: tuple[int, int] = SIMILAR,
) -> DataFrame:
    """Edges ``a, b`` between classes that connect exactly what similar word sequences connect.

    ``classes`` has ``doc, root``: the class each sequence is in already. See :func:`shingle_sets` for the others.
    """
    top, base = similar
    sets = stored(shingle_sets(texts, total, size, similar))
    # ``room`` counts the shingles from this one on: a bound of what a pair that meets here first can share.
    posted = stored(sets.select(F.col("doc").alias("x"), "n", "before", "indexed", F.posexplode("prefix").alias("i", "h")).select(
        "x", "n", "h", "before", (F.col("n") - F.col("before") - F.col("i")).alias("room"), (F.col("i") < F.col("indexed")).alias("short"),
    ))
    now = stored(classes.join(sets.select("doc"), "doc").groupBy(F.col("doc").alias("x")).agg(F.min("root").alias("a")))
    edges = classes.select(F.col("root").alias("a"), F.col("root").alias("b")).limit(0)
    # The shorter one, or either of equal ones, is indexed, and the sizes and what is left allow the similarity.
    fits = (
        ((F.col("short") & (F.col("n") <= F.col("m"))) | (F.col("brief") & (F.col("m") <= F.col("n"))))
        & (F.least("n", "m") * base >= F.greatest("n", "m") * top)
        & (F.least("room", "left") * (top + base) >= (F.col("n") + F.col("m")) * top) & (F.col("a") != F.col("b"))
    )
    before = None
    while True:
        held = posted.join(now, "x")
        # The one with the fewest shingles of its own: a text is so preferred to what was made of it.
        one = F.max(F.struct((-F.col("before")).alias("own"), "short", "x", "n", "room")).alias("one")
        groups = held.groupBy("h", "a").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("short")).alias("s"), one)
        buckets = stored(groups.groupBy("h").agg(
            F.sum("c").alias("all"), F.sum("s").alias("brief"), F.sum(F.col("c") * F.col("s")).alias("same"),
            F.max(F.struct("c", "one", "a")).alias("top"),
        ).where("`all` * brief > same"))
        rows, left = buckets.agg(
            F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum(F.col("all") * F.col("brief") - F.col("same")), F.lit(0)),
        ).first()
        if not rows:
            return edges
        last = left <= PAIRS * rows or before is not None and left * 10 > before * 9
        if last:
            open_ = held.join(buckets.select("h"), "h")
            other = open_.where("short").select(
                "h", F.col("x").alias("y"), F.col("n").alias("m"), F.col("room").alias("left"), F.col("a").alias("b"),
                F.col("short").alias("brief"),
            )
            pairs = open_.join(other, "h")
        else:
            pairs = held.join(buckets.select("h", "top"), "h").select(
                "x", "n", "a", "room", "short", F.col("top.one.x").alias("y"), F.col("top.one.n").alias("m"),
                F.col("top.a").alias("b"), F.col("top.one.room").alias("left"), F.col("top.one.short").alias("brief"),
            )
        ordered = pairs.where(fits).select(
            F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"),
            F.when(F.col("x") <= F.col("y"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.when(F.col("x") <= F.col("y"), F.col("b")).otherwise(F.col("a")).alias("b"),
        )
        new = stored(verified(ordered.distinct(), sets, similar))
        edges = edges.union(new)
        if last:
            return edges
        moved = components(new).select(F.col("node").alias("a"), "root")
        now = stored(now.join(moved, "a", "left").select("x", F.coalesce("root", "a").alias("a")))
        before = left


def deduplicate_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = WORDS,
    similar: tuple[int, int] = SIMILAR,
) -> DataFrame:
    """One row of each class, see :func:`near_duplicates.deduplicate`; edited copies are in one class too.

    The row with the smallest id stays, of rows that share it any one; rows without id come last. A missing text
    counts as empty; texts of fewer than ``size`` words are linked by fingerprint and equal words only, and texts
    without words are one class. An empty table stays empty, and columns of any name stay as they are.
    """

    def kernel():
        def work(column: pa.Array) -> dict:
            words = [(t or b"").lower().split() for t in column.cast(pa.binary()).to_pylist()]
            return {
                "fp": [simhash(w) for w in words], "doc": [xxhash.xxh64_intdigest(b" ".join(w)) - 2**63 for w in words],
                "n": [len(w) for w in words],
            }

        return work

    made = map_column(docs, text, kernel, "fp bigint, doc bigint, n bigint")
    fp, doc, n = made.columns[-3:]
    row = free_name(made, "row")
    marked = stored(made.withColumn(row, F.monotonically_increasing_id()))
    body = F.col(f"`{text}`").cast("binary")
    unique = stored(marked.select(F.col(f"`{fp}`").alias("fp")).distinct())
    linked = components(link_fingerprints(unique, radius))
    roots = stored(unique.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))
    long = marked.where(F.col(f"`{n}`") >= size)
    total = long.agg(F.coalesce(F.sum(f"`{n}`"), F.lit(0))).first()[0]
    texts = long.select(F.col(f"`{doc}`").alias("doc"), body.alias("_text"))
    classes = long.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{fp}`").alias("fp")).distinct().join(roots, "fp")
    more = components(link_copies(texts, classes.select("doc", "root"), total, size, similar))
    final = roots.join(more.withColumnRenamed("root", "_root"), F.col("root") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("_root", "root").alias("root")
    )
    return first_of_each(marked, final, doc_id, fp, row).select(*columns_of(docs))
