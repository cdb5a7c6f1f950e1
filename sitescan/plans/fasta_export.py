"""Sites -> FASTA records of the bases under them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitescan.functions import fasta_id
from sitescan.operators.filters import project_sites, rule_filter
from sitescan.operators.ordering import with_ordinal
from sitescan.operators.sequences import contig_lengths, extract_sequences, locate_sites
from sitescan.operators.sites import resize_sites
from sitescan.plans.generate import stored_chunks
from sitescan.session import cut_lineage
from sitescan.sources import read_fasta_chunks, read_table, write_fasta


def filtered_sites(
    sites: DataFrame,
    order_col: str,
    rules: Sequence[tuple[int | str, Any]] | None = None,
    default_pass: bool = True,
    cols: Sequence[int | str] = (0, 1, 2),
    length: int = 0,
) -> DataFrame:
    """(chr_n, pos_ini, pos_end, ordinal): the rows the rules let through, resized, numbered from 1."""
    passed = project_sites(rule_filter(sites, rules, default_pass), cols, keep=[order_col])
    numbered = with_ordinal(resize_sites(passed, length), order_col, "_n")
    return numbered.select("chr_n", "pos_ini", "pos_end", (F.col("_n") + 1).alias("ordinal"))


def fasta_records(
    filtered: DataFrame, chunks: DataFrame, clamp: bool = False, seen: Observation | None = None
) -> DataFrame:
    """(ordinal, id, seq); sites without a sequence leave a gap in the ordinals, and ``seen`` receives how many
    they are (see ``locate_sites``)."""
    located = locate_sites(filtered, contig_lengths(chunks), clamp=clamp, seen=seen)
    if seen is not None:
        located = cut_lineage(located)  # its rows are read twice below, and counted once
    return extract_sequences(located, chunks).select(
        "ordinal", fasta_id("ordinal", "chr_n", "pos_ini", "pos_end").alias("id"), "seq"
    )


def run_fasta_export(
    spark: SparkSession,
    sites_path: str,
    fasta_path: str,
    output_path: str,
    rules: Sequence[tuple[int | str, Any]] | None = None,
    default_pass: bool = True,
    cols: Sequence[int | str] = (0, 1, 2),
    length: int = 0,
    clamp: bool = False,
    fasta_genome: str | None = None,
    seen: Observation | None = None,
) -> DataFrame:
    """A ``;`` table in, FASTA parts in record order out; returns the filtered sites.

    ``seen`` receives ``n_sites`` and ``n_skipped``, counted while the job runs.
    """
    sites = read_table(spark, sites_path, row_order=True)
    filtered = cut_lineage(filtered_sites(sites, "row_ord", rules, default_pass, cols, length))
    chunks = stored_chunks(read_fasta_chunks(spark, fasta_path, genome=fasta_genome), filtered)
    write_fasta(fasta_records(filtered, chunks, clamp, seen), output_path)
    return filtered
