"""Sites + genes + a motif panel -> sites with genes and co-occupancy flags, and the panel's hits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitescan.defaults import DIST_GENES, DIST_SITES, PSEUDOCOUNT, SCORE_MULT
from sitescan.operators.filters import SITE_COLUMNS, site_key_columns, skipped_count
from sitescan.operators.motifs import longest_motif, motif_cutoffs
from sitescan.operators.ordering import with_ordinal
from sitescan.operators.scan import scan
from sitescan.operators.sequences import contig_lengths, locate_sites, prune_chunks
from sitescan.operators.sites import expand_sites, site_hits
from sitescan.operators.stats import cooccupancy_flags, gene_string
from sitescan.plans.generate import stored_chunks, window_overlap
from sitescan.session import cut_lineage
from sitescan.sources import read_fasta_chunks, read_genes, read_motifs, read_table, write_table

SITE_ID = "site_id"
GENES = "str_genes_rnaseq_near"
_OVERLAID = ("chr_n", "pos_ini", "pos_end", "seq", "source", "score_pssm", "tf_name")


class CooccupancyTables:
    """The two tables; each plan is built when it is first asked for. ``site_id`` orders the sites.

    ``skipped`` has one row, ``n_skipped``: the sites whose chromosome has no sequence, which leave both tables.
    """

    def __init__(self, make_sites: Callable[[], DataFrame], make_other: Callable[[], DataFrame], skipped: DataFrame):
        self._make_sites, self._make_other, self.skipped = make_sites, make_other, skipped

    @cached_property
    def sites(self) -> DataFrame:
        return self._make_sites()

    @cached_property
    def other_tf(self) -> DataFrame:
        return self._make_other()


def cooccupancy(
    sites: DataFrame,
    genes: DataFrame,
    chunks: DataFrame,
    motifs: DataFrame,
    names: Sequence[str],
    dist_sites: int = DIST_SITES,
    dist_genes: int = DIST_GENES,
    score_mult: float = SCORE_MULT,
    label_mode: str = "inherited",
    one_based: bool = False,
    clamp: bool = False,
    float32: bool = False,
    materialize: bool = False,
    counts: bool = False,
) -> CooccupancyTables:
    """Both tables as lazy DataFrames.

    ``sites`` has a unique ``site_id`` next to its own columns; its coordinates are found by name, else as
    the first three other columns. ``names`` are the motif names that get a flag column. In the hits table a
    site column wins over a hit column of the same name; the hit's own values stay in ``hit_*`` columns. ``counts``
    takes the flags from sorted hit positions, which pays where many sites share many hits.
    """
    own = [c for c in sites.columns if c != SITE_ID]
    clash = set(own) & {*names, GENES}
    if clash:
        raise ValueError(f"site columns {sorted(clash)} would be overwritten by the report")
    contigs = contig_lengths(chunks)
    located, skipped = _located(sites, own, contigs, dist_sites, clamp)
    carried = [F.col(f"_own.`{c}`").alias(c) for c in own]

    hits = scan(
        prune_chunks(chunks, located), motifs=motifs, score_mult=score_mult, float32=float32
    )
    named = gene_string(located, genes, dist_genes, label_mode, GENES, key=SITE_ID)
    if materialize:
        hits, named = cut_lineage(hits), cut_lineage(named)

    tail = [F.col(f"`{c}`") for c in (GENES, *names)]

    def sites_table() -> DataFrame:
        longest = longest_motif(motifs) if counts else None
        return cooccupancy_flags(named, hits, names, key=SITE_ID, longest=longest).select(SITE_ID, *carried, *tail)

    def hits_table() -> DataFrame:
        # A site in the hits table has its hits at hand, so its flags need no second pass over the scan;
        # the group of a site is as large as its own hits.
        of_site = Window.partitionBy(SITE_ID)
        found = site_hits(named, hits, one_based).withColumns({
            n: F.coalesce(F.max(F.when(F.col("hit_tf_name") == n, 1)).over(of_site), F.lit(0)) for n in names
        })
        from_hit = {
            "chr_n": "chr_n", "pos_ini": "hit_pos_ini", "pos_end": "hit_pos_end", "seq": "hit_seq",
            "source": "hit_source", "score_pssm": "hit_score", "tf_name": "hit_tf_name",
        }
        overlaid = [
            F.col(f"_own.`{c}`").alias(c) if c in own else F.col(from_hit[c]).alias(c) for c in _OVERLAID
        ]
        rest = [F.col(f"_own.`{c}`").alias(c) for c in own if c not in _OVERLAID]
        return found.select(
            SITE_ID, *overlaid, *rest, *tail, "hit_pos_ini", "hit_pos_end", "hit_seq", "hit_score",
            "hit_tf_name", "hit_strand", "hit_ord",
        )

    return CooccupancyTables(sites_table, hits_table, skipped)


def _located(
    sites: DataFrame, own: list[str], contigs: DataFrame, dist: int, clamp: bool
) -> tuple[DataFrame, DataFrame]:
    """Sites on a known contig, their own columns packed aside, with the expanded slice; and how many are not."""
    keys = site_key_columns(sites.select(*[F.col(f"`{c}`") for c in own]))
    packed = sites.select(
        SITE_ID,
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own"),
        *[
            (F.col(f"`{k}`") if n == "chr_n" else F.col(f"`{k}`").cast("bigint")).alias(n)
            for k, n in zip(keys, SITE_COLUMNS)
        ],
    )
    located = locate_sites(expand_sites(packed, dist), contigs, "search_ini", "search_end", clamp)
    return located.drop("search_ini", "search_end"), skipped_count(packed.select("chr_n"), contigs)


def run_cooccupancy(
    spark: SparkSession,
    sites_path: str,
    genes_path: str,
    fasta_path: str,
    motif_path: str,
    output_prefix: str,
    names: dict[str, str] | None = None,
    dist_sites: int = DIST_SITES,
    dist_genes: int = DIST_GENES,
    score_mult: float = SCORE_MULT,
    score_report: bool = False,
    label_mode: str = "inherited",
    one_based: bool = False,
    clamp: bool = False,
    float32: bool = False,
    pseudocount: float = PSEUDOCOUNT,
    fasta_genome: str | None = None,
) -> CooccupancyTables:
    """Files in, ``<prefix>_sites_genes`` and ``<prefix>_other_tf`` out; ``skipped`` of the result counts the
    sites without a sequence.

    ``names`` renames motif files for display; without it a motif is called after its file.
    """
    sites = with_ordinal(read_table(spark, sites_path, row_order=True), "row_ord", SITE_ID)
    genes = with_ordinal(read_genes(spark, genes_path, row_order=True), "row_ord", "gene_ord")
    motifs = cut_lineage(read_motifs(spark, motif_path, pseudocount, names=names))
    if score_report:
        motif_cutoffs(motifs, score_mult).show(truncate=False)
    order = motifs.groupBy("motif").agg(F.min("motif_ord").alias("o")).orderBy("o", "motif")
    columns = [r["motif"] for r in order.toLocalIterator()]
    sites = cut_lineage(sites)
    keys = site_key_columns(sites.drop(SITE_ID))
    named = sites.select(F.col(f"`{keys[0]}`").alias("chr_n"))
    overlap = window_overlap(motifs=motifs)
    chunks = stored_chunks(read_fasta_chunks(spark, fasta_path, overlap=overlap, genome=fasta_genome), named)
    tables = cooccupancy(
        sites, cut_lineage(genes), chunks, motifs, columns, dist_sites, dist_genes, score_mult,
        label_mode, one_based, clamp, float32, materialize=True, counts=True,
    )
    own_ids = [SITE_ID]
    write_table(tables.sites, f"{output_prefix}_sites_genes", order_by=[SITE_ID], drop=own_ids)
    write_table(
        tables.other_tf, f"{output_prefix}_other_tf",
        order_by=[SITE_ID, "hit_ord", F.desc("hit_strand"), "hit_pos_ini"], drop=[*own_ids, "hit_ord"],
    )
    return tables
