"""Peaks + expression -> peaks, sites and genes tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitescan.defaults import CHUNK_OVERLAP, CORE_WORDS, DIST_GENES, PSEUDOCOUNT, SCORE_MULT
from sitescan.operators.expression import annotate_expression
from sitescan.operators.filters import sample_peaks
from sitescan.operators.intervals import nearby_genes
from sitescan.operators.motifs import longest_motif
from sitescan.operators.ordering import with_ordinal
from sitescan.operators.scan import scan
from sitescan.operators.sequences import contig_lengths, locate_sites, prune_chunks
from sitescan.operators.sites import site_hits
from sitescan.operators.stats import GENE_STATS, distinct_genes, first_peaks, peak_gene_stats, peak_site_stats
from sitescan.session import cut_lineage
from sitescan.sources import (
    read_annotation, read_bed, read_expression, read_fasta_chunks, read_motifs, write_table,
)

PEAK_ID = "peak_id"


class GenerateTables:
    """The three tables; each plan is built when it is first asked for.

    ``peak_id`` orders the peaks; ``site_order()`` orders the sites. ``counts`` has what was counted on the way
    where the tables were materialized: ``n_sites`` and ``n_skipped``, and of a job over files ``n_rows``,
    ``n_ids`` and ``n_genes`` of its expression table.
    """

    def __init__(self, peaks: DataFrame, located: DataFrame, genes: DataFrame, dist: int, counted, hits,
                 one_based: bool, materialize: bool, ordered: bool, longest: int | None):
        self._columns, self._located, self._genes, self._dist = peaks.columns, located, genes, dist
        self._make_counted, self._make_hits = counted, hits
        self._ordered, self._longest = ordered, longest
        self.counts: dict[str, int] = {}
        self._one_based, self._keep = one_based, cut_lineage if materialize else lambda df: df

    @cached_property
    def counted(self) -> DataFrame:
        """Located peaks with their gene counts."""
        return self._keep(self._make_counted())

    @cached_property
    def hits(self) -> DataFrame:
        """Word and motif hits in contig coordinates."""
        return self._keep(self._make_hits())

    @cached_property
    def peaks(self) -> DataFrame:
        extra = [c for c in self._columns if c not in (PEAK_ID, "chr_n", "pos_ini", "pos_end")]
        return peak_site_stats(self.counted, self.hits, longest=self._longest).select(
            PEAK_ID, "chr_n", "pos_ini", "pos_end", *extra, "n_genes", "n_su", "n_su_list", "n_su_pssm",
            *GENE_STATS[1:],
        )

    @cached_property
    def sites(self) -> DataFrame:
        return site_hits(self.counted, self.hits, self._one_based).select(
            PEAK_ID, "chr_n",
            F.col("hit_pos_ini").alias("pos_ini"), F.col("hit_pos_end").alias("pos_end"),
            F.col("hit_seq").alias("seq"), F.col("hit_source").alias("source"),
            F.col("hit_score").alias("score_pssm"), F.col("n_genes").alias("n_genes_near"),
            "n_updown_total", "n_upreg", "n_downreg",
            F.col("hit_strand").alias("strand"), "hit_ord",
        )

    @cached_property
    def genes(self) -> DataFrame:
        """Each gene once; ``gene_ord`` sorts by the first peak near it, then by the gene's own position."""
        narrow = self._located.select(PEAK_ID, "chr_n", "pos_ini", "pos_end")
        if self._ordered:
            near = first_peaks(narrow, self._genes, PEAK_ID, self._dist, keep_start=True)
        else:
            near = nearby_genes(narrow, self._genes, self._dist, keep_start=True)
        return distinct_genes(near, PEAK_ID, keep_order=True)


def site_order() -> list[Column]:
    """Words first, by word and position; then the motif's reverse hits, then its forward hits."""
    forward = F.when((F.col("source") == "pssm") & (F.col("strand") == "+"), 1).otherwise(0)
    return [F.col(PEAK_ID), F.col("source"), F.col("hit_ord"), forward, F.col("pos_ini")]


def generate(
    peaks: DataFrame,
    genes: DataFrame,
    expression: DataFrame,
    chunks: DataFrame | Callable[[], DataFrame],
    words: Sequence[str] = (),
    motifs: DataFrame | None = None,
    score_mult: float = SCORE_MULT,
    cutoffs: dict[str, float] | float | None = None,
    dist: int = DIST_GENES,
    one_based: bool = False,
    clamp: bool = False,
    float32: bool = False,
    materialize: bool = False,
    contigs: DataFrame | None = None,
    ordered: bool = False,
    counts: bool = False,
) -> GenerateTables:
    """The three tables as lazy DataFrames.

    ``peaks`` is (peak_id, chr_n, pos_ini, pos_end, ...) with a unique, ordered ``peak_id``. Peaks on a
    chromosome without sequence leave all three tables. ``materialize=True`` stores the per-peak gene
    counts and the hits, which two of the tables share. With ``contigs`` (chr_n, contig_len)
    the lengths are not read from the chunks, and ``chunks`` may be a function that is called when the hits are
    asked for. ``ordered`` says that no peak or gene ends before it starts; ``counts`` counts the hits
    of the peaks from sorted positions, which pays where many peaks share many hits.
    """
    made = chunks if callable(chunks) else lambda: chunks
    seen = Observation("sites") if materialize else None
    located = locate_sites(peaks, contig_lengths(made()) if contigs is None else contigs, clamp=clamp, seen=seen)
    if materialize:
        located = cut_lineage(located)
    with_expression = annotate_expression(genes, expression)
    tables = GenerateTables(
        peaks, located, with_expression, dist,
        counted=lambda: peak_gene_stats(located, with_expression, dist, ordered=ordered),
        hits=lambda: scan(prune_chunks(made(), located), words, motifs, score_mult, cutoffs, float32),
        one_based=one_based, materialize=materialize, ordered=ordered,
        longest=max(max(map(len, words), default=0), longest_motif(motifs)) if counts else None,
    )
    if seen:
        tables.counts.update(seen.get)
    return tables


def window_overlap(words: Sequence[str] = (), motifs: DataFrame | None = None) -> int:
    """Bases a chunk must carry beyond its own: the longest word or motif less one, or the usual number."""
    return max(CHUNK_OVERLAP, max(map(len, words), default=0) - 1, longest_motif(motifs) - 1)


def stored_chunks(chunks: DataFrame, sites: DataFrame) -> DataFrame:
    """The chunks of the chromosomes the sites lie on, stored; the others are not."""
    named = sites.where("chr_n is not null").select(F.col("chr_n").alias("_site_chr")).distinct()
    return cut_lineage(chunks.join(named, F.col("chr_n") == F.col("_site_chr"), "left_semi"))


def run_generate(
    spark: SparkSession,
    bed_path: str,
    expression_path: str,
    annotation_path: str,
    fasta_path: str,
    output_prefix: str,
    motif_path: str | None = None,
    words: Sequence[str] = tuple(CORE_WORDS),
    score_mult: float = SCORE_MULT,
    score_cutoff: float | None = None,
    dist: int = DIST_GENES,
    test_mode: int = 0,
    seed: int = 0,
    id_col: int = 0,
    value_col: int = 3,
    name_col: int | None = None,
    expression_sep: str = ";",
    one_based: bool = False,
    clamp: bool = False,
    float32: bool = False,
    pseudocount: float = PSEUDOCOUNT,
    fasta_genome: str | None = None,
) -> GenerateTables:
    """Files in, three ``;`` tables out: ``<prefix>_peaks``, ``<prefix>_binding_sites``, ``<prefix>_genes``."""
    peaks = with_ordinal(read_bed(spark, bed_path, row_order=True), "row_ord", PEAK_ID)
    peaks = cut_lineage(sample_peaks(peaks, test_mode, seed))
    annotation = cut_lineage(read_annotation(spark, annotation_path))
    loaded = Observation("expression")
    expression = read_expression(
        spark, expression_path, id_col, value_col, name_col,
        annotation if name_col is not None else None, sep=expression_sep, seen=loaded,
    )
    expression = cut_lineage(expression)
    motifs = cut_lineage(read_motifs(spark, motif_path, pseudocount)) if motif_path else None
    overlap = window_overlap(words, motifs)
    chunks = stored_chunks(read_fasta_chunks(spark, fasta_path, overlap=overlap, genome=fasta_genome), peaks)
    ordered = peaks.where("pos_end < pos_ini").isEmpty() and annotation.where("g_end < g_start").isEmpty()
    tables = generate(
        peaks, annotation, expression, chunks, words, motifs, score_mult, score_cutoff, dist,
        one_based, clamp, float32, materialize=True, ordered=ordered, counts=True,
    )
    tables.counts.update(loaded.get, n_genes=expression.count())
    write_table(
        tables.sites, f"{output_prefix}_binding_sites", order_by=site_order(),
        drop=[PEAK_ID, "strand", "hit_ord"],
    )
    write_table(
        tables.genes, f"{output_prefix}_genes", order_by=["gene_ord"], drop=["gene_ord"],
    )
    write_table(tables.peaks, f"{output_prefix}_peaks", order_by=[PEAK_ID], drop=[PEAK_ID])
    return tables
