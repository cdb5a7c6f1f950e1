"""Differential expression: one signed fold change per gene, first row wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitescan.functions import parse_number, signed_fold_change, split_ids


def expression_rows(raw: DataFrame, seen: Observation | None = None) -> DataFrame:
    """(row_ord, raw_id, raw_value[, gene_name]) -> one row per identifier with its fold change.

    Rows whose value is no number are dropped; a missing value is a number (NaN). ``seen`` receives ``n_rows``,
    the usable rows, and ``n_ids``, their identifiers, when the result is first computed.
    """
    extra = ["gene_name"] if "gene_name" in raw.columns else []
    parsed = raw.select("row_ord", "raw_id", *extra, parse_number("raw_value").alias("_log2"))
    usable = parsed.where(F.col("_log2").isNotNull())
    if seen is not None:
        ids = F.coalesce(F.sum(F.size(split_ids("raw_id"))), F.lit(0)).cast("bigint")
        usable = usable.observe(seen, F.count(F.lit(1)).alias("n_rows"), ids.alias("n_ids"))
    return usable.select(
        "row_ord", *extra,
        F.explode(split_ids("raw_id")).alias("gene_id"),
        signed_fold_change("_log2").alias("fold_change"),
    )


def translate_names(rows: DataFrame, annotation: DataFrame) -> DataFrame:
    """Gene names -> identifiers, many to many; names the annotation lacks are dropped.

    The rows of a name are folded to their distinct values before the join, so a name that fills a third
    of the file meets its genes once per value, not once per row.
    """
    names = annotation.select("gene_name", F.col("gene_id").alias("_gene_id")).distinct()
    folded = rows.groupBy("gene_name", "fold_change").agg(
        F.min("row_ord").alias("row_ord"), F.count(F.lit(1)).alias("n_rows")
    )
    return folded.join(names, "gene_name").select(
        "row_ord", "gene_name", F.col("_gene_id").alias("gene_id"), "fold_change", "n_rows"
    )


def first_translated(rows: DataFrame, annotation: DataFrame) -> DataFrame:
    """(gene_id, fold_change) by gene name: only the first row of each name can win, so one row per name
    goes into the join however many rows a name has."""
    first = rows.groupBy("gene_name").agg(
        F.min_by("fold_change", "row_ord").alias("fold_change"), F.min("row_ord").alias("row_ord")
    )
    names = annotation.select("gene_name", F.col("gene_id").alias("_gene_id"))
    return first_fold_change(
        first.join(names, "gene_name").select("row_ord", F.col("_gene_id").alias("gene_id"), "fold_change")
    )


def first_fold_change(rows: DataFrame) -> DataFrame:
    """(gene_id, fold_change): the first row of each gene wins."""
    return rows.groupBy("gene_id").agg(F.min_by("fold_change", "row_ord").alias("fold_change"))


def expression_conflicts(rows: DataFrame) -> DataFrame:
    """(gene_id, fold_change, n_conflicts): genes with later rows that differ from the one kept.

    A missing value (NaN) differs from everything, another NaN included.
    """
    n = F.sum("n_rows") if "n_rows" in rows.columns else F.count(F.lit(1))
    per_value = rows.groupBy("gene_id", "fold_change").agg(n.alias("n"), F.min("row_ord").alias("row_ord"))
    same = F.when(F.isnan("fold_change"), F.lit(1)).otherwise(F.col("n"))
    return (
        per_value.groupBy("gene_id")
        .agg(
            F.min_by("fold_change", "row_ord").alias("fold_change"),
            (F.sum("n") - F.min_by(same, "row_ord")).alias("n_conflicts"),
        )
        .where(F.col("n_conflicts") > 0)
    )


def expression_summary(raw: DataFrame, annotation: DataFrame | None = None) -> DataFrame:
    """One row (n_rows, n_ids, n_genes): usable rows, identifiers mapped, distinct genes.

    With an ``annotation`` the identifiers are the gene's name translated, once per identifier in the row.
    """
    rows = expression_rows(raw)
    if annotation is not None:
        rows = translate_names(rows, annotation)
        n = F.sum("n_rows")
    else:
        n = F.count(F.lit(1))
    zero = F.lit(0).cast("bigint")
    usable = raw.where(parse_number("raw_value").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_rows"), zero.alias("n_ids"), zero.alias("n_genes")
    )
    # Genes are folded map-side, then one row per gene is counted.
    genes = rows.groupBy("gene_id").agg(n.alias("n")).agg(
        zero.alias("n_rows"), F.coalesce(F.sum("n"), zero).alias("n_ids"), F.count(F.lit(1)).alias("n_genes")
    )
    return usable.unionByName(genes).agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_ids", "n_genes")])


def annotate_expression(genes: DataFrame, expression: DataFrame) -> DataFrame:
    """Genes with their ``fold_change``; null where the expression table has none.

    Joined before the peaks are: a gene near many peaks is then looked up once.
    """
    return genes.join(expression.select("gene_id", "fold_change"), "gene_id", "left").select(
        *genes.columns, "fold_change"
    )
