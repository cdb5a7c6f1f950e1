"""The three user-level jobs, each a composition of the operators."""

from sitescan.plans.cooccupancy import CooccupancyTables, cooccupancy, run_cooccupancy
from sitescan.plans.fasta_export import fasta_records, filtered_sites, run_fasta_export
from sitescan.plans.generate import GenerateTables, generate, run_generate

__all__ = [
    "CooccupancyTables", "GenerateTables", "cooccupancy", "fasta_records", "filtered_sites", "generate",
    "run_cooccupancy", "run_fasta_export", "run_generate",
]
