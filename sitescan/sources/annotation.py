"""Gene annotation from GTF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GTF = (
    "contig string, src string, feature string, g_start bigint, g_end bigint, score string, "
    "strand string, frame string, attributes string"
)


def _attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{name} "([^"]*)"', 1), F.lit(""))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, gene_name, contig, g_start, g_end, strand, biotype), one row per gene.

    A gene's own ``gene`` row gives its span. Old releases have none: there the span is that of all rows of
    the gene, and the biotype is the source column.
    """
    rows = spark.read.schema(_GTF).csv(path, sep="\t", comment="#", quote="").select(
        _attribute("gene_id").alias("gene_id"), _attribute("gene_name").alias("gene_name"),
        F.regexp_replace("contig", "^chr", "").alias("contig"), "g_start", "g_end", "strand",
        F.coalesce(_attribute("gene_biotype"), _attribute("gene_type"), F.col("src")).alias("biotype"),
        (F.col("feature") == "gene").alias("_own"),
    ).where(F.col("gene_id").isNotNull())
    # One grouping serves both kinds of file: the struct of a gene row, or the span of the others.
    own = F.col("_own")
    any_own = F.bool_or(own)
    return rows.groupBy("gene_id", "contig", "strand").agg(
        F.max(F.when(own, F.col("gene_name"))).alias("_name_own"), F.max("gene_name").alias("_name"),
        F.min(F.when(own, F.col("g_start"))).alias("_start_own"), F.min("g_start").alias("_start"),
        F.max(F.when(own, F.col("g_end"))).alias("_end_own"), F.max("g_end").alias("_end"),
        F.max(F.when(own, F.col("biotype"))).alias("_biotype_own"),
        F.max(F.when(F.col("biotype") == "protein_coding", F.col("biotype"))).alias("_coding"),
        F.max("biotype").alias("_biotype"),
        any_own.alias("_has_own"),
    ).select(
        "gene_id",
        F.coalesce("_name_own", "_name").alias("gene_name"),
        "contig",
        F.coalesce("_start_own", "_start").alias("g_start"),
        F.coalesce("_end_own", "_end").alias("g_end"),
        "strand",
        F.when(F.col("_has_own"), F.col("_biotype_own"))
        .otherwise(F.coalesce("_coding", "_biotype")).alias("biotype"),
    )
