"""Aggregations over peaks, genes and hits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescan.defaults import BIOTYPE, DIST_GENES, HIT_BIN_BITS
from sitescan.functions import contig, gene_origin
from sitescan.operators.counting import count_contained, count_overlaps, smallest_overlapping
from sitescan.operators.grouping import per_row
from sitescan.operators.intervals import genes_around, hits_in_slices, nearby_genes
from sitescan.operators.sequences import SLICE_COLUMNS

GENE_STATS = ("n_genes", "n_updown_total", "n_upreg", "n_downreg")


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def gene_counts() -> list[Column]:
    """Genes near, genes with a fold change (zero and NaN included), up and down.

    Spark orders NaN above every number, so it is kept out of the up count by hand.
    """
    fc = F.col("fold_change")
    return [
        F.count("gene_id").alias("n_genes"),
        F.count(fc).alias("n_updown_total"),
        F.count_if((fc > 0) & ~F.isnan(fc)).alias("n_upreg"),
        F.count_if(fc < 0).alias("n_downreg"),
    ]


def peak_gene_stats(
    peaks: DataFrame, genes: DataFrame, dist: int = DIST_GENES, biotype: str | None = BIOTYPE,
    bits: int | None = None, ordered: bool = False,
) -> DataFrame:
    """Peaks with ``n_genes, n_updown_total, n_upreg, n_downreg``; zeros for a peak without genes.

    ``peaks`` needs a column that makes its rows unique; ``genes`` carry ``fold_change`` (see
    ``annotate_expression``). The counts come from sorted boundaries (see :mod:`counting`), not from pairs. That
    holds for intervals that end at or after their start; the others take the pairs, unless ``ordered`` says that
    there are none.
    """
    fold, d = F.col("fold_change"), F.lit(int(dist)).cast("bigint")
    some = genes if biotype is None else genes.where(F.col("biotype") == biotype)
    weights = dict(zip(GENE_STATS, (
        F.lit(1), fold.isNotNull().cast("int"), F.coalesce((fold > 0) & ~F.isnan(fold), F.lit(False)).cast("int"),
        F.coalesce(fold < 0, F.lit(False)).cast("int"),
    )))
    weights["n_genes"] = F.col("gene_id").isNotNull().cast("int")
    straight = F.coalesce(F.col("g_start") <= F.col("g_end"), F.lit(False))
    lo, hi = F.col("pos_ini") - d, F.col("pos_end") + d

    def counted(rows: DataFrame) -> DataFrame:
        return count_overlaps(
            rows, contig("chr_n"), lo, hi, some if ordered else some.where(straight), F.col("contig"), F.col("g_start"),
            F.col("g_end"), weights,
        )

    if ordered:
        return counted(peaks)
    plain = F.coalesce(lo <= hi, F.lit(True))
    crossed = per_row(nearby_genes(peaks.where(~plain), genes, dist, biotype, "left", bits), peaks.columns, *gene_counts())
    odd = nearby_genes(peaks.where(plain), some.where(~straight), dist, None, bits=bits)
    odd = per_row(odd, peaks.columns, *gene_counts()).select(
        F.struct(*_columns(peaks)).alias("_odd"), *[F.col(n).alias(f"_{n}") for n in GENE_STATS]
    )
    most = counted(peaks.where(plain)).join(odd, F.struct(*_columns(peaks)).eqNullSafe(F.col("_odd")), "left")
    added = [(F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in GENE_STATS]
    return most.select(*_columns(peaks), *added).unionByName(crossed)


def gene_peak_sums(
    peaks: DataFrame, genes: DataFrame, weights: Mapping[str, Column], dist: int = DIST_GENES, biotype: str | None = BIOTYPE,
) -> DataFrame:
    """``gene_id`` with the sum of each weight over the peaks near it, as grouping the pairs of :func:`nearby_genes` gives.

    ``n``, the number of pairs, is added. No pair is made, whatever the lengths: the sums come from sorted boundaries
    (see :mod:`counting`). Peaks and genes end at or after their start; genes without a peak are left out.
    """
    d = F.lit(int(dist)).cast("bigint")
    some = genes if biotype is None else genes.where(F.col("biotype") == biotype)
    counted = count_overlaps(
        some.select("gene_id", "contig", "g_start", "g_end"), F.col("contig"), F.col("g_start") - d, F.col("g_end") + d,
        peaks, contig("chr_n"), F.col("pos_ini"), F.col("pos_end"), {"n": F.lit(1), **weights},
    )
    return counted.where("n > 0").groupBy("gene_id").agg(*[F.sum(c).alias(c) for c in ("n", *weights)])


def distinct_genes(pairs: DataFrame, order_col: str, keep_order: bool = False) -> DataFrame:
    """(gene_id, chr_n, pos0, biotype, fold_change): each gene once, as its first peak saw it.

    ``keep_order`` adds ``gene_ord``, which sorts by first occurrence: the first peak, then the gene's start
    (``pairs`` then carry ``g_start``). It is unique.
    """
    cols = ["chr_n", "pos0", "biotype", "fold_change"]
    lead = F.col("g_start") if keep_order else F.lit(0)
    # First fold to one row per gene and spelling of its chromosome with a fixed-width buffer (a hash
    # aggregate, map-side); only then pick the first spelling.
    folded = pairs.groupBy("gene_id", *cols).agg(F.min(order_col).alias("_first"), F.min(lead).alias("_lead"))
    first = F.min_by(F.struct(*cols, "_first", "_lead"), "_first").alias("_row")
    row = folded.groupBy("gene_id").agg(first)
    order = [F.struct(F.col("_row._first").alias("first"), F.col("_row._lead").alias("start"), "gene_id").alias("gene_ord")]
    return row.select("gene_id", *[F.col(f"_row.{c}").alias(c) for c in cols], *(order if keep_order else []))


def first_peaks(
    peaks: DataFrame, genes: DataFrame, order_col: str, dist: int = DIST_GENES, biotype: str | None = BIOTYPE,
    keep_start: bool = False,
) -> DataFrame:
    """The pair of each gene with its first peak, as :func:`nearby_genes` would give it, without the other pairs.

    The rows feed :func:`distinct_genes` in place of all pairs. ``order_col`` orders the peaks. Peaks and genes end
    at or after their start; genes so short that they fit into a bin (only with a distance below 32) are paired.
    """
    d = F.lit(int(dist)).cast("bigint")
    some = genes if biotype is None else genes.where(F.col("biotype") == biotype)
    kept = [F.col(c) for c in ("gene_id", "biotype", "contig", "g_start", "g_end")]
    fold = [F.col("fold_change")] if "fold_change" in genes.columns else []
    side = some.select(*kept, gene_origin("strand", "g_start", "g_end").alias("pos0"), *fold)
    shortest, least = 2 * max(int(dist), 0) + 1, 64
    wide = side if shortest >= least else side.where(F.col("g_end") - F.col("g_start") + shortest >= least)
    # A gene asks for both spellings of its chromosome. The peaks then fold to a plain number: in a hash table, where
    # a pair of number and name would have each task sort all its peaks.
    bare = F.when(~F.startswith(F.col("contig"), F.lit("chr")), F.col("contig"))
    spelled = wide.withColumn("chr_n", F.explode(F.array(F.concat(F.lit("chr"), "contig"), bare))).where("chr_n is not null")
    least_of = smallest_overlapping(
        spelled, F.col("chr_n"), F.col("g_start") - d, F.col("g_end") + d, max(shortest, least), peaks, F.col("chr_n"),
        F.col("pos_ini"), F.col("pos_end"), F.col(order_col), "_order",
    )
    first = F.min(F.struct(F.col("_order").alias("order"), "chr_n")).alias("_first")
    found = per_row(least_of.select(*_columns(wide), "_order", "chr_n"), wide.columns, first).select(
        F.col("_first.chr_n").alias("chr_n"), F.col("_first.order").alias(order_col), "gene_id", "pos0", "biotype", *fold, "g_start",
    )
    if shortest < least:
        short = some.where(F.col("g_end") - F.col("g_start") + shortest < least)
        pairs = nearby_genes(peaks.select(order_col, "chr_n", "pos_ini", "pos_end"), short, dist, None, keep_start=True)
        found = found.unionByName(pairs.select(*found.columns))
    return found if keep_start else found.drop("g_start")


def peak_site_stats(peaks: DataFrame, hits: DataFrame, bits: int = HIT_BIN_BITS, longest: int | None = None) -> DataFrame:
    """Located peaks with ``n_su, n_su_list, n_su_pssm``; slice columns are dropped.

    ``longest`` is the length of the longest hit. With it the counts come from sorted hit positions, and only
    slices shorter than that are paired with their hits, which are then few however many the hits around are.
    """
    keep = [F.col(f"`{c}`") for c in peaks.columns if c not in SLICE_COLUMNS]
    names = ("n_su", "n_su_list", "n_su_pssm")
    if longest is None:
        pairs = hits_in_slices(peaks, hits.select("chr_n", "start", "hit_len", "source"), "left", bits)
        counted = per_row(
            pairs, peaks.columns, F.count("hit_source").alias("n_su"),
            *[F.count_if(F.col("hit_source") == s).alias(f"n_su_{s}") for s in ("list", "pssm")],
        )
        return counted.select(*keep, *names)
    size = F.col("slice_end") - F.col("slice_ini")
    weights = dict(zip(names, (F.lit(1), (F.col("source") == "list").cast("int"), (F.col("source") == "pssm").cast("int"))))
    counted = count_contained(
        peaks.where(size >= longest), F.col("chr_n"), F.col("slice_ini"), F.col("slice_end"), hits, F.col("chr_n"),
        F.col("start"), F.col("start") + F.col("hit_len"), weights,
    )
    few = peak_site_stats(peaks.where(size < longest), hits, bits)
    return counted.select(*keep, *names).unionByName(few)


def reported_start(pos_ini_shift: Column | str = "slice_shift", one_based: bool = False) -> Column:
    """First base of a hit in the site's coordinates.

    Word hits are 1-based. Motif hits are inherited one lower; ``one_based=True`` aligns them.
    """
    shift = F.col(pos_ini_shift) if isinstance(pos_ini_shift, str) else pos_ini_shift
    first = F.col("hit_start") + shift
    if one_based:
        return first + 1
    return F.when(F.col("hit_source") == "list", first + 1).otherwise(first)


def _per_key(sites: DataFrame, key: str | None, pairs: Callable[[DataFrame], DataFrame], bounds: Sequence[str], *aggregates: Column) -> DataFrame:
    """``sites`` with the aggregates over their pairs.

    With a unique ``key`` only the key and the bounds are paired and grouped, and the row is joined back once;
    without one the whole row travels through the pairs.
    """
    if key is None:
        return per_row(pairs(sites), sites.columns, *aggregates)
    narrow = sites.select(F.col(f"`{key}`").alias("_id"), *[F.col(f"`{c}`") for c in bounds if c != key])
    found = pairs(narrow).groupBy("_id").agg(*aggregates)
    made = [F.col(f"`{c}`") for c in found.columns if c != "_id"]
    return sites.join(found, F.col(f"`{key}`") == F.col("_id")).select(*_columns(sites), *made)


def gene_string(
    sites: DataFrame, genes: DataFrame, dist: int = DIST_GENES, label_mode: str = "inherited",
    name: str = "str_genes_rnaseq_near", bits: int | None = None, key: str | None = None,
) -> DataFrame:
    """Sites with ``gene_up,gene_down,...`` in gene order; an empty string without genes.

    ``key`` names a column that is unique and never null; the sites' other columns then stay out of the pairs.
    """
    item = F.when(F.col("gene_id").isNotNull(), F.concat(F.col("gene_id"), F.lit("_"), F.col("updown")))
    listed = F.expr("coalesce(listagg(_item, ',') within group (order by _gord), '')").alias(name)

    def pairs(left: DataFrame) -> DataFrame:
        found = genes_around(left, genes, dist, label_mode, how="left", bits=bits)
        return found.select(*_columns(left), item.alias("_item"), F.col("gene_ord").alias("_gord"))

    return _per_key(sites, key, pairs, ("chr_n", "pos_ini", "pos_end"), listed)


def cooccupancy_flags(
    located: DataFrame, hits: DataFrame, names: Sequence[str], bits: int = HIT_BIN_BITS, key: str | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Located sites with one 0/1 column per motif name; ``key`` as in :func:`gene_string`.

    With ``longest``, the length of the longest hit, the flags come from sorted hit positions as the counts of
    :func:`peak_site_stats` do, and only shorter slices are paired with their hits.
    """
    clash = set(names) & set(located.columns)
    if clash:
        raise ValueError(f"motif names {sorted(clash)} are also site columns")
    if not names:
        return located
    narrow = hits.select("chr_n", "start", "hit_len", "tf_name")
    if longest is not None:
        size = F.col("slice_end") - F.col("slice_ini")
        counts = {f"_n{i}": F.coalesce(F.col("tf_name") == n, F.lit(False)).cast("int") for i, n in enumerate(names)}
        counted = count_contained(
            located.where(size >= longest), F.col("chr_n"), F.col("slice_ini"), F.col("slice_end"), narrow, F.col("chr_n"),
            F.col("start"), F.col("start") + F.col("hit_len"), counts,
        )
        most = counted.select(*_columns(located), *[(F.col(f"_n{i}") > 0).cast("int").alias(n) for i, n in enumerate(names)])
        return most.unionByName(cooccupancy_flags(located.where(size < longest), hits, names, bits, key))
    flags = [
        F.coalesce(F.max(F.when(F.col("hit_tf_name") == n, 1)), F.lit(0)).alias(n) for n in names
    ]
    return _per_key(
        located, key, lambda left: hits_in_slices(left, narrow, "left", bits), ("chr_n", *SLICE_COLUMNS), *flags
    )
