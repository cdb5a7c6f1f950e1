"""Column expressions: every one stays JVM-side and takes part in whole-stage codegen."""

from sitescan.functions.scalars import (
    contig,
    direction_label,
    expand_bounds,
    fasta_id,
    gene_origin,
    is_missing,
    parse_number,
    resize_bounds,
    reverse_complement,
    revcomp,
    signed_fold_change,
    split_ids,
)

__all__ = [
    "contig", "direction_label", "expand_bounds", "fasta_id", "gene_origin", "is_missing", "parse_number",
    "resize_bounds", "revcomp", "reverse_complement", "signed_fold_change", "split_ids",
]
