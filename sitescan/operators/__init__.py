"""Joins, scans and aggregations; every operator takes and returns DataFrames."""

from sitescan.operators.expression import (
    annotate_expression, expression_conflicts, expression_rows, expression_summary, first_fold_change,
    first_translated, translate_names,
)
from sitescan.operators.filters import project_sites, rule_filter, sample_peaks, skipped_count, split_by_sequence
from sitescan.operators.hit_counts import count_motif_hits, count_windows, count_word_hits
from sitescan.operators.intervals import genes_around, hits_in_slices, nearby_genes
from sitescan.operators.kmer_counts import count_kmers
from sitescan.operators.motifs import motif_cutoffs, motif_log_odds
from sitescan.operators.ordering import first_per_key, with_file_order, with_ordinal
from sitescan.operators.scan import scan, scan_motifs, scan_words
from sitescan.operators.sequences import (
    chunk_layout, chunk_sequences, contig_lengths, extract_sequences, kmers, locate_sites, prune_chunks, with_layout,
)
from sitescan.operators.sites import expand_sites, resize_sites, site_hits
from sitescan.operators.stats import (
    cooccupancy_flags, distinct_genes, first_peaks, gene_peak_sums, gene_string, peak_gene_stats, peak_site_stats,
)

__all__ = [
    "annotate_expression", "chunk_layout", "chunk_sequences", "contig_lengths", "cooccupancy_flags", "count_kmers",
    "count_motif_hits", "count_windows", "count_word_hits", "distinct_genes",
    "expand_sites", "expression_conflicts", "expression_rows", "expression_summary", "extract_sequences",
    "first_fold_change", "first_peaks", "first_per_key", "first_translated",
    "gene_peak_sums", "gene_string", "genes_around", "hits_in_slices", "kmers",
    "locate_sites", "motif_cutoffs", "motif_log_odds", "nearby_genes", "peak_gene_stats", "peak_site_stats",
    "project_sites", "prune_chunks", "resize_sites", "rule_filter", "sample_peaks", "scan", "scan_motifs",
    "scan_words", "site_hits", "skipped_count", "split_by_sequence", "translate_names", "with_file_order",
    "with_layout", "with_ordinal",
]
