"""Interval joins as binned equi-joins.

A bare range condition makes Spark compare every pair of a chromosome. Here both sides are put into
bins of ``2**bits`` bases, joined on (key, bin) with the exact range test as a residual, and a pair is
kept only in the first bin the two sides share, so no ``distinct`` follows.

The search distance widens the *small* side (genes, hits). The large side (peaks, sites) is exploded
over its own few hundred bases only, which is one bin for nearly every row, so it is shuffled once and
hardly grows. No side is forced to be broadcast: Catalyst and AQE do it when the measured size is under
``spark.sql.autoBroadcastJoinThreshold``; otherwise the sort-merge join on (key, bin) is split by AQE
when one bin holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescan.defaults import BIOTYPE, DIST_GENES, HIT_BIN_BITS
from sitescan.functions import contig, direction_label, gene_origin


#: Nested bins widen by this many bits a level, up to the whole of a contig.
STEP, TOP = 5, 32


def bits_for(dist: int) -> int:
    """Bin width exponent for a search distance: about twice the distance, at least 4096 bases."""
    return max((2 * max(int(dist), 0) - 1).bit_length(), 12)


def _bins(df: DataFrame, key: Column, lo: Column, hi: Column, bits: int, side: str, outer: bool) -> DataFrame:
    # least/greatest: an inverted interval still meets its partners between its two ends.
    first = F.shiftright(F.least(lo, hi).cast("bigint"), bits)
    last = F.shiftright(F.greatest(lo, hi).cast("bigint"), bits)
    spread = F.explode_outer if outer else F.explode
    return df.select(
        "*", key.alias(f"_{side}_key"), first.alias(f"_{side}_first"),
        spread(F.sequence(first, last)).alias(f"_{side}_bin"),
    )


def binned_join(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    residual: Column,
    bits: int,
    how: str = "inner",
) -> DataFrame:
    """Pairs of equal key whose spans meet and that pass ``residual``.

    With ``how='left'`` a left row that touches k bins may come back with up to k empty partners; the
    callers group by the left row afterwards and count partners, so that is harmless.
    """
    lhs = _bins(left, left_key, *left_span, bits, "l", how == "left")
    rhs = _bins(right, right_key, *right_span, bits, "r", False)
    on = (
        (F.col("_l_key") == F.col("_r_key"))
        & (F.col("_l_bin") == F.col("_r_bin"))
        & (F.col("_l_bin") == F.greatest("_l_first", "_r_first"))
        & residual
    )
    return lhs.join(rhs, on, how).drop("_l_key", "_r_key", "_l_first", "_r_first", "_l_bin", "_r_bin")


def _level(lo: Column, hi: Column, bits: int) -> Column:
    """The narrowest of the bin widths ``2**bits, 2**(bits + STEP), ...`` that is at least the interval's length."""
    length = F.abs(hi.cast("bigint") - lo.cast("bigint")) + 1
    level = F.lit(bits)
    for b in range(bits, TOP, STEP):
        level = F.when(length > (1 << b), min(b + STEP, TOP)).otherwise(level)
    return level


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur: at most one for each bin width, whatever the table's size."""
    return sorted(r[0] for r in df.select("_level").where("_level is not null").distinct().collect())


def _places(low: Column, high: Column, level: Column) -> Column:
    return F.transform(F.sequence(low, high), lambda x: F.struct(level.alias("level"), x.alias("bin"), low.alias("first")))


def _spread(df: DataFrame, own: bool, levels: list[int], lo: Column, hi: Column, side: str, outer: bool) -> DataFrame:
    """Rows of ``df`` for its bins at ``levels`` not below its own; ``own`` tells whether its own level counts."""
    first, last = F.least(lo, hi).cast("bigint"), F.greatest(lo, hi).cast("bigint")
    places = []
    for b in levels:
        at = _places(F.shiftright(first, b), F.shiftright(last, b), F.lit(b))
        places.append(F.when(F.col("_level") <= b if own else F.col("_level") < b, at))
    none = F.array().cast("array<struct<level:int,bin:bigint,first:bigint>>")
    listed = F.flatten(F.array(*[F.coalesce(p, none) for p in places])) if places else none
    return df.withColumn(f"_{side}_place", (F.explode_outer if outer else F.explode)(listed))


def nested_join(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    residual: Column,
    bits: int = 12,
) -> DataFrame:
    """The inner :func:`binned_join` for spans of very different lengths.

    Bins are nested: a span lives on the level whose bins are just wider than it is, where it touches two at most.
    A pair meets on the level of its longer span: the longer one stands in its own bins, the shorter one visits
    the bins above its own, of the levels that occur on the other side. A span is so put into a few rows
    however long it is, and long spans don't fill the bins that short ones use.
    """
    lhs = left.withColumn("_l_key", left_key).withColumn("_level", _level(*left_span, bits))
    rhs = right.withColumn("_r_key", right_key).withColumn("_level", _level(*right_span, bits))
    both = []
    # The longer (or equally long) span on the right, then the longer one on the left.
    for right_longer in (True, False):
        home, guest = (rhs, lhs) if right_longer else (lhs, rhs)
        levels = _levels(home)
        spans = (right_span, left_span) if right_longer else (left_span, right_span)
        sides = ("r", "l") if right_longer else ("l", "r")
        first, last = F.least(*spans[0]).cast("bigint"), F.greatest(*spans[0]).cast("bigint")
        low, high = (F.call_function("shiftright", x, F.col("_level")) for x in (first, last))
        at = _places(low, high, F.col("_level"))
        home = home.withColumn(f"_{sides[0]}_place", F.explode(at)).drop("_level")
        guest = _spread(guest, right_longer, levels, *spans[1], sides[1], False).drop("_level")
        lhs_, rhs_ = (guest, home) if right_longer else (home, guest)
        on = (
            (F.col("_l_key") == F.col("_r_key")) & (F.col("_l_place.level") == F.col("_r_place.level"))
            & (F.col("_l_place.bin") == F.col("_r_place.bin"))
            & (F.col("_l_place.bin") == F.greatest("_l_place.first", "_r_place.first")) & residual
        )
        both.append(lhs_.join(rhs_, on).drop("_l_key", "_r_key", "_l_place", "_r_place"))
    return both[0].unionByName(both[1])


def _joined(nested: bool, *args) -> DataFrame:
    if not nested:
        return binned_join(*args)
    if args[-1] != "inner":
        raise ValueError("nested bins make inner joins only")
    return nested_join(*args[:-1])


def _gene_side(genes: DataFrame, biotype: str | None) -> DataFrame:
    if biotype is not None:
        genes = genes.where(F.col("biotype") == biotype)
    keep = [F.col("fold_change")] if "fold_change" in genes.columns else []
    return genes.select(
        "gene_id",
        gene_origin("strand", "g_start", "g_end").alias("pos0"),
        "biotype",
        *keep,
        F.col("contig").alias("_contig"),
        F.col("g_start").alias("_g_start"),
        F.col("g_end").alias("_g_end"),
    )


def nearby_genes(
    peaks: DataFrame,
    genes: DataFrame,
    dist: int = DIST_GENES,
    biotype: str | None = BIOTYPE,
    how: str = "inner",
    bits: int | None = None,
    keep_start: bool = False,
    nested: bool = False,
) -> DataFrame:
    """Genes whose body overlaps ``[pos_ini - dist, pos_end + dist]``, both ends inclusive.

    Adds ``gene_id, pos0, biotype`` (and ``fold_change`` when the genes carry it, ``g_start`` with
    ``keep_start``) to the peak columns. ``nested`` takes bins by the length of each interval, for peaks or genes
    of very different lengths (inner joins only).
    """
    d = F.lit(int(dist)).cast("bigint")
    side = _gene_side(genes, biotype)
    clash = set(peaks.columns) & set(side.columns)
    if clash:
        raise ValueError(f"peak columns {sorted(clash)} clash with the gene columns")
    joined = _joined(
        nested, peaks, side,
        contig("chr_n"), F.col("_contig"),
        (F.col("pos_ini"), F.col("pos_end")),
        (F.col("_g_start") - d, F.col("_g_end") + d),
        (F.col("_g_start") <= F.col("pos_end") + d) & (F.col("_g_end") >= F.col("pos_ini") - d),
        bits_for(dist) if bits is None else bits,
        how,
    )
    if keep_start:
        joined = joined.withColumn("g_start", F.col("_g_start"))
    return joined.drop("_contig", "_g_start", "_g_end")


def genes_around(
    sites: DataFrame,
    genes: DataFrame,
    dist: int = DIST_GENES,
    label_mode: str = "inherited",
    how: str = "inner",
    bits: int | None = None,
    nested: bool = False,
) -> DataFrame:
    """Genes of the same ``chr_n`` whose origin lies strictly inside ``(pos_ini - dist, pos_end + dist)``.

    ``genes`` is a genes table (``gene_id, chr_n, pos0, fold_change`` and an optional ``gene_ord``).
    Adds ``gene_id, updown, gene_pos0, gene_ord``. ``nested`` as in :func:`nearby_genes`.
    """
    d = F.lit(int(dist)).cast("bigint")
    order = F.col("gene_ord") if "gene_ord" in genes.columns else F.col("pos0")
    label = direction_label("fold_change", label_mode)
    side = genes.select(
        "gene_id", label.alias("updown"), F.col("pos0").alias("gene_pos0"), order.alias("gene_ord"),
        F.col("chr_n").alias("_gene_chr"),
    )
    if label_mode == "signed":
        side = side.where(F.col("updown").isNotNull())
    joined = _joined(
        nested, sites, side,
        F.col("chr_n"), F.col("_gene_chr"),
        (F.col("pos_ini"), F.col("pos_end")),
        (F.col("gene_pos0") - d, F.col("gene_pos0") + d),
        (F.col("gene_pos0") > F.col("pos_ini") - d) & (F.col("gene_pos0") < F.col("pos_end") + d),
        bits_for(dist) if bits is None else bits,
        how,
    )
    return joined.drop("_gene_chr")


def hits_in_slices(
    located: DataFrame, hits: DataFrame, how: str = "inner", bits: int = HIT_BIN_BITS
) -> DataFrame:
    """Scan hits that lie wholly inside the located slice of a site (see ``locate_sites``).

    Hit columns come back prefixed with ``hit_``: ``hit_start`` is the 0-based contig position.
    """
    side = hits.select(*[F.col(c).alias(c if c.startswith("hit_") else f"hit_{c}") for c in hits.columns])
    return binned_join(
        located, side,
        F.col("chr_n"), F.col("hit_chr_n"),
        (F.col("slice_ini"), F.greatest(F.col("slice_end") - 1, F.col("slice_ini"))),
        (F.col("hit_start"), F.col("hit_start")),
        (F.col("hit_start") >= F.col("slice_ini"))
        & (F.col("hit_start") + F.col("hit_len") <= F.col("slice_end")),
        bits,
        how,
    ).drop("hit_chr_n")
