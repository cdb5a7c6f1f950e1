"""Counts and minima over intervals and points without their pairs.

An interval meets [lo, hi] unless it starts after hi or ends before lo, so the number of those that meet it is
the number of starts up to hi less the number of ends before lo. Both come from sorted boundaries: a contig's
boundaries are folded by position, cut into bins, and each bin keeps its positions as a sorted array with running
sums, and the sums of all bins before it. A count is two equi-joins on (contig, bin) and two binary searches,
however many intervals there are around.

The smallest row that meets [lo, hi] comes from bins that are no wider than the shortest [lo, hi]: a bin inside
it gives the smallest of all its rows, its first bin the smallest of those that end at lo or later, its last
the smallest of those that start at hi or earlier.

A bin has at most ``2**bits`` different positions whatever the number of rows, so no array grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescan.session import cut_lineage

BIN_BITS = 12


def at_most(positions: str, limit: str) -> str:
    """SQL for how many of the ascending ``positions`` are no greater than ``limit``: a binary search by bits."""
    steps = f"transform(sequence(length(bin(size({positions}))) - 1, 0, -1), b -> shiftleft(1, b))"
    return (
        f"aggregate({steps}, 0, (at, step) -> if(at + step <= size({positions}) "
        f"and get({positions}, at + step - 1) <= {limit}, at + step, at))"
    )


def boundary_bins(points: DataFrame, names: list[str], bits: int = BIN_BITS) -> DataFrame:
    """``_side, _bin, _at, _sums, _before, _last``: the bins of each ``_side`` of ``points`` (``_side, _pos`` and
    weights called ``names``), without gaps up to its last one.

    ``_at`` are the positions in the bin and ``_sums`` the running sums of the weights up to each of them;
    ``_before`` are the sums of all earlier bins and ``_last`` says whether the side has no later one.
    """
    listed = ", ".join(names)
    folded = points.groupBy("_side", "_pos").agg(*[F.sum(n).alias(n) for n in names])
    inside = "(partition by _side, _bin order by _pos rows between unbounded preceding and current row)"
    running = folded.selectExpr("*", f"shiftright(_pos, {bits}) as _bin").selectExpr(
        "_side", "_bin", *names, f"struct(_pos, struct({', '.join(f'sum({n}) over {inside} as {n}' for n in names)}) as _sum) as _row"
    )
    # Stored, so that the bins' sums below are rows of a few numbers and their window holds no positions.
    packed = cut_lineage(running.groupBy("_side", "_bin").agg(
        F.expr("sort_array(collect_list(_row)) as _rows"), *[F.sum(n).alias(n) for n in names]
    ).selectExpr(
        "_side", "_bin", "transform(_rows, r -> r._pos) as _at", "transform(_rows, r -> r._sum) as _sums", f"struct({listed}) as _own"
    ))
    # One row a bin: at most the contig's length over the bin's width.
    earlier = "(partition by _side order by _bin rows between unbounded preceding and 1 preceding)"
    bins = packed.selectExpr(
        "_side", "_bin", "lead(_bin) over (partition by _side order by _bin) as _next", "_own",
        f"struct({', '.join(f'coalesce(sum(_own.{n}) over {earlier}, 0L) as {n}' for n in names)}) as _before",
    )
    # Empty bins up to the next one carry the sums on, so that every lookup is an equi-join.
    spread = bins.selectExpr("*", "explode(sequence(_bin, coalesce(_next - 1, _bin))) as _b")
    total = f"struct({', '.join(f'_before.{n} + _own.{n} as {n}' for n in names)})"
    sums = spread.selectExpr(
        "struct(_side, _b as _bin) as _key", f"if(_b = _bin, _before, {total}) as _before", "_next is null as _last"
    )
    # Joined by both as one struct: a hot side is many bins, and no partitioning by the side alone will do.
    filled = packed.selectExpr("struct(_side, _bin) as _packed", "_at", "_sums")
    joined = sums.join(filled, F.expr("_key = _packed"), "left")
    return joined.selectExpr(
        "_key._side as _side", "_key._bin as _bin", "coalesce(_at, cast(array() as array<bigint>)) as _at", "_sums", "_before", "_last",
    )


def sums_up_to(rows: DataFrame, limit: str, bins: DataFrame, side: int, names: list[str], out: str, bits: int = BIN_BITS) -> DataFrame:
    """``rows`` with ``out``: a struct of the sums over all boundaries of ``_k`` up to ``limit``, zeros without any."""
    columns = [f"`{c}`" for c in rows.columns]
    own = bins.where(f"_side.kind = {side}")
    last = own.where("_last").selectExpr("_side.key as _lastkey", "_bin as _lastbin")
    placed = rows.join(last, F.expr("_k = _lastkey"), "left").selectExpr(
        *columns, f"{limit} as _limit", f"least(shiftright({limit}, {bits}), _lastbin) as _wanted"
    )
    table = own.selectExpr("_side.key as _binkey", "_bin", "_at", "_sums", "_before")
    found = placed.join(table, F.expr("_k = _binkey and _wanted = _bin"), "left")
    sums = ", ".join(f"coalesce(_before.{n}, 0L) + coalesce(_here.{n}, 0L) as {n}" for n in names)
    # The search is a column of its own, so that it runs once for all sums.
    return found.selectExpr(*columns, "_before", f"get(_sums, {at_most('_at', '_limit')} - 1) as _here").selectExpr(
        *columns, f"struct({sums}) as {out}"
    )


def count_overlaps(
    left: DataFrame, left_key: Column, lo: Column, hi: Column, right: DataFrame, right_key: Column, start: Column, end: Column,
    weights: Mapping[str, Column], bits: int = BIN_BITS,
) -> DataFrame:
    """``left`` with the sum of each weight over the rows of ``right`` whose [start, end] meets [lo, hi].

    No pair is made. Both sides' intervals must end at or after their start; rows with a missing key or bound
    meet nothing.
    """
    names = list(weights)
    narrow = right.select(
        right_key.alias("_key"), start.cast("bigint").alias("_s"), end.cast("bigint").alias("_e"),
        *[w.cast("bigint").alias(n) for n, w in weights.items()],
    ).where("_key is not null and _s is not null and _e is not null")
    # Both boundaries go through one grouping; the bins are read four times and their size is then known.
    points = narrow.selectExpr("_key", "explode(array(struct(0 as kind, _s as at), struct(1 as kind, _e as at))) as _b", *names)
    points = points.selectExpr("struct(_b.kind as kind, _key as key) as _side", "_b.at as _pos", *names)
    bins = cut_lineage(boundary_bins(points, names, bits))
    whole = lo.isNotNull() & hi.isNotNull()
    rows = left.select("*", F.when(whole, left_key).alias("_k"), lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"))
    rows = sums_up_to(rows, "_hi", bins, 0, names, "_begun", bits)
    rows = sums_up_to(rows, "_lo - 1", bins, 1, names, "_ended", bits)
    return rows.selectExpr(*[f"`{c}`" for c in left.columns], *[f"_begun.{n} - _ended.{n} as {n}" for n in names])


def count_contained(
    left: DataFrame, left_key: Column, lo: Column, hi: Column, right: DataFrame, right_key: Column, start: Column, end: Column,
    weights: Mapping[str, Column], bits: int = BIN_BITS,
) -> DataFrame:
    """``left`` with the sum of each weight over the rows of ``right`` that lie in [lo, hi), ends exclusive.

    Those that end by hi less those that start before lo: exact where no row of ``right`` reaches over both, that
    is where hi - lo is at least the longest of them.
    """
    return count_overlaps(left, left_key, lo, hi, right, right_key, end, start, weights, bits)


def smallest_overlapping(
    left: DataFrame, left_key: Column, lo: Column, hi: Column, shortest: int, right: DataFrame, right_key: Column,
    start: Column, end: Column, smallest: Column, name: str,
) -> DataFrame:
    """``left`` with ``name``: the least value ``smallest`` of the rows of ``right`` whose [start, end] meets [lo, hi].

    Rows of ``left`` that meet none are left out. No pair is made: ``left`` is put into the bins it covers, whose
    width is a power of two up to ``shortest``, the least length of any [lo, hi].
    """
    bits = max(int(shortest), 1).bit_length() - 1
    rows = right.select(right_key.alias("_key"), start.cast("bigint").alias("_s"), end.cast("bigint").alias("_e"), smallest.alias("_v"))
    rows = rows.where("_key is not null and _s <= _e")
    touched = rows.selectExpr("*", f"explode(sequence(shiftright(_s, {bits}), shiftright(_e, {bits}))) as _bin")
    # Positions outside the bin count as its edge, so a bin has no more of them than it is wide; equal ones are
    # folded before they meet.
    low, high = f"shiftleft(_bin, {bits})", f"shiftleft(_bin + 1, {bits}) - 1"
    edges = touched.selectExpr(
        "_key", "_bin", "_v", f"explode(array(struct(0 as kind, greatest(_s, {low}) as at), struct(1 as kind, least(_e, {high}) as at))) as _edge"
    )
    folded = edges.groupBy("_key", "_bin", "_edge").agg(F.min("_v").alias("_v"))
    ahead = "(partition by _key, _bin, _edge.kind order by _edge.at rows between unbounded preceding and current row)"
    behind = "(partition by _key, _bin, _edge.kind order by _edge.at rows between current row and unbounded following)"
    best = folded.selectExpr(
        "_key", "_bin", "_edge.kind as kind", f"struct(_edge.at as at, if(_edge.kind = 0, min(_v) over {ahead}, min(_v) over {behind}) as v) as _row", "_v"
    )
    bins = cut_lineage(best.groupBy("_key", "_bin").agg(
        F.expr("sort_array(collect_list(_row) filter (where kind = 0))").alias("_starts"),
        F.expr("sort_array(collect_list(_row) filter (where kind = 1))").alias("_ends"), F.min("_v").alias("_least"),
    ).selectExpr(
        "_key as _binkey", "_bin", "transform(_starts, r -> r.at) as _start_at", "transform(_starts, r -> r.v) as _start_v",
        "transform(_ends, r -> r.at) as _end_at", "transform(_ends, r -> r.v) as _end_v", "_least",
    ))
    own = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"), left_key.alias("_k"), lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"))
    placed = own.where("_k is not null and _lo <= _hi").selectExpr(
        "*", f"explode(sequence(shiftright(_lo, {bits}), shiftright(_hi, {bits}))) as _b"
    )
    met = placed.join(bins, F.expr("_k = _binkey and _b = _bin"))
    value = (
        f"case when _lo > shiftleft(_b, {bits}) then get(_end_v, {at_most('_end_at', '_lo - 1')}) "
        f"when _hi < shiftleft(_b + 1, {bits}) - 1 then get(_start_v, {at_most('_start_at', '_hi')} - 1) else _least end as _v"
    )
    found = met.selectExpr("_left", value).where("_v is not null").groupBy("_left").agg(F.min("_v").alias("_v"))
    return found.select(*[F.col(f"_left.`{c}`").alias(c) for c in left.columns], F.col("_v").alias(name))
