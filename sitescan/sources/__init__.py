"""File readers and writers."""

from sitescan.sources.annotation import read_annotation
from sitescan.sources.fasta import read_fasta, read_fasta_chunks
from sitescan.sources.motif_files import read_motif_counts, read_motifs
from sitescan.sources.tables import (
    read_bed, read_expression, read_expression_rows, read_genes, read_raw_expression, read_table,
)
from sitescan.sources.writers import write_bed, write_fasta, write_table

__all__ = [
    "read_annotation", "read_bed", "read_expression", "read_expression_rows", "read_fasta",
    "read_fasta_chunks", "read_genes", "read_motif_counts", "read_motifs", "read_raw_expression",
    "read_table", "write_bed", "write_fasta", "write_table",
]
