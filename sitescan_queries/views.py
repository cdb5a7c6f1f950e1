"""Genomic tables derived from the given ones; every view covers its whole source table.

A third of the peaks sits on one contig (``chr0``), a third of the expression rows on one gene (``G6``) and
a third of the gene names is ``N7``, so the hot-key paths are always exercised. About a tenth of the peaks
lies on contigs without a sequence, some on contigs whose sequence is empty, and some start below position 1.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescan.operators import (
    annotate_expression, chunk_sequences, contig_lengths, expression_rows, first_fold_change, motif_log_odds,
)
from sitescan.session import cut_lineage

OVERLAP = 15
DIST = 100
DIST_ORIGIN = 200
DIST_SITES = 50
MULT = 0.75

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTANacgtacgtacgtacgtacgtacgtan"
#: Blanks, marks and digits go; what is left and not in LETTERS, letters of other alphabets above all, is N.
NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]"
OTHER = r"[^A-Za-z]"
_DROPPED = "".join(chr(c) for c in range(128) if chr(c) not in LETTERS)

CHR_N = (
    "case when event_id % 3 = 0 then 'chr0' when event_id % 50 = 1 then concat('chrE', event_id % 25) "
    "else concat('chr', cast(floor(event_id / 9) as bigint)) end"
)
POS_INI = "(user_id * 37 + event_id) % 1500 - 5"
POS_END = f"{POS_INI} + 50 + event_id % 150"

# Intervals of very different lengths, from an integer k.
LONG_CHR = "case when {k} % 3 = 0 then 'chr0' else concat('chr', {k} % 20) end"
LONG_INI = "({k} * 7919) % 40000000"
LONG_SIZE = (
    "case when {k} % 50 = 7 then 1999990 when {k} % 11 = 3 then 5000 + {k} % 90000 else 9 + {k} % 400 end"
)
MANY_BASE = "1 + (l_suppkey * 3 + l_linenumber * (1 + l_suppkey % 3) + case when l_quantity < 40 then 0 else l_quantity end) % 4"


class Views:
    """Lazy DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def seqs(self) -> DataFrame:
        """Every text as a contig, and an empty contig for each nation."""
        # Letters are changed and other ASCII characters dropped in one go; what is neither counts as an N did.
        letters = F.translate("text", LETTERS + _DROPPED, BASES)
        texts = self.spread(self.table("documents").select("doc_id", "text")).select(
            F.expr("concat('chr', doc_id)").alias("chr_n"),
            F.regexp_replace(letters, OTHER, BASES[LETTERS.index("N")]).alias("seq"),
        )
        empty = self.table("nation").select(F.expr("concat('chrE', n_nationkey)").alias("chr_n"), F.lit("").alias("seq"))
        return texts.unionByName(empty)

    def spread(self, df: DataFrame) -> DataFrame:
        """A table of few splits dealt to all cores before the work on its texts starts."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def chunks(self) -> DataFrame:
        """Stored, as the jobs do: the texts are read once however often a query needs the sequences."""
        return self.chunked(OVERLAP)

    def chunked(self, overlap: int, size: int = 4096) -> DataFrame:
        return cut_lineage(chunk_sequences(self.seqs, size, overlap))

    @cached_property
    def contigs(self) -> DataFrame:
        """Lengths where the bases are needed too; see ``lengths``."""
        return contig_lengths(self.chunks)

    @cached_property
    def lengths(self) -> DataFrame:
        """Lengths straight from the texts, where no bases are needed."""
        return self.seqs.select("chr_n", F.length("seq").cast("bigint").alias("contig_len"))

    @cached_property
    def peaks(self) -> DataFrame:
        return self.table("events").selectExpr(
            "cast(event_id as bigint) as peak_id", f"{CHR_N} as chr_n",
            f"cast({POS_INI} as bigint) as pos_ini", f"cast({POS_END} as bigint) as pos_end",
        )

    @cached_property
    def genes(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('G', p_partkey) as gene_id",
            "concat('N', cast(floor(p_partkey / 3) as bigint)) as gene_name",
            "cast(cast(floor(p_partkey / 2) as bigint) as string) as contig",
            "cast(1 + (p_partkey * 131) % 1500 as bigint) as g_start",
            "cast(1 + (p_partkey * 131) % 1500 + p_size * 10 as bigint) as g_end",
            "case when p_partkey % 2 = 0 then '+' else '-' end as strand",
            "case when p_type = 'ECONOMY' then 'pseudogene' else 'protein_coding' end as biotype",
        )

    @cached_property
    def raw_expression(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "cast(o_orderkey as bigint) as row_ord",
            "concat(case when o_orderkey % 3 = 0 then 'G6' "
            "else concat('G', 2 * cast(floor(o_orderkey / 7) as bigint)) end, "
            "' | G', 3 * cast(floor(o_orderkey / 5) as bigint), '|') as raw_id",
            "case when o_orderkey % 3 = 1 then 'N7' "
            "else concat('N', cast(floor(o_orderkey / 20) as bigint)) end as gene_name",
            "case when o_orderkey % 11 = 0 then 'bad' when o_orderkey % 13 = 0 then 'NA' "
            "else cast((o_custkey % 9 - 4) * 0.5 as string) end as raw_value",
        )

    @cached_property
    def expression(self) -> DataFrame:
        return first_fold_change(expression_rows(self.raw_expression))

    @cached_property
    def motif_counts(self) -> DataFrame:
        """Three motifs, 7, 6 and 5 positions long, with one strong base per position."""
        place = "((l_linenumber - 1) % (7 - l_suppkey % 3))"
        offset = (
            "case when l_quantity <= 35 then 0 when l_quantity <= 42 then 1 "
            "when l_quantity <= 46 then 2 else 3 end"
        )
        base = f"substring('ACGT', 1 + ({offset} + {place} * (1 + l_suppkey % 3) + l_suppkey % 3) % 4, 1)"
        return (
            self.table("lineitem")
            .selectExpr("concat('M', l_suppkey % 3) as motif", f"cast({place} as int) as pos", f"{base} as base")
            .groupBy("motif", "pos", "base")
            .agg(F.count(F.lit(1)).cast("double").alias("count"))
        )

    @cached_property
    def motifs(self) -> DataFrame:
        return motif_log_odds(self.motif_counts)

    @cached_property
    def long_peaks(self) -> DataFrame:
        """Peaks of 10 to 2,000,000 bases on twenty contigs; a third lies on one."""
        return self.table("orders").selectExpr(
            "cast(o_orderkey as bigint) as peak_id", f"{LONG_CHR.format(k='o_orderkey')} as chr_n",
            f"cast({LONG_INI.format(k='o_orderkey')} as bigint) as pos_ini",
            f"cast({LONG_INI.format(k='o_orderkey')} + {LONG_SIZE.format(k='o_orderkey')} as bigint) as pos_end",
        )

    @cached_property
    def long_genes(self) -> DataFrame:
        return self.genes.select("gene_id", "gene_name", "strand", "biotype", F.expr("cast(substring(gene_id, 2) as bigint)").alias("k")).selectExpr(
            "gene_id", "gene_name", "strand", "biotype", f"substring({LONG_CHR.format(k='k')}, 4) as contig",
            f"cast({LONG_INI.format(k='k * 3')} as bigint) as g_start",
            f"cast({LONG_INI.format(k='k * 3')} + {LONG_SIZE.format(k='(k + 5)')} as bigint) as g_end",
        )

    @cached_property
    def many_motif_counts(self) -> DataFrame:
        """A motif of seven positions for every supplier."""
        return self.table("lineitem").selectExpr(
            "concat('S', l_suppkey) as motif", "cast((l_linenumber - 1) % 7 as int) as pos",
            f"substring('ACGT', cast({MANY_BASE} as int), 1) as base",
        ).groupBy("motif", "pos", "base").agg(F.count(F.lit(1)).cast("double").alias("count"))

    @cached_property
    def sites(self) -> DataFrame:
        """A sites table with columns of its own; blank and missing chromosomes occur."""
        return self.table("events").selectExpr(
            "cast(event_id as bigint) as site_id",
            f"case when event_id % 97 = 0 then '' when event_id % 89 = 0 then null else {CHR_N} end as chr_n",
            f"cast({POS_INI} as bigint) as pos_ini", f"cast({POS_END} as bigint) as pos_end",
            "concat('S', event_type) as seq", "event_type as source", "cast(value as double) as score_pssm",
        )

    @cached_property
    def gene_table(self) -> DataFrame:
        """A genes table as the generate job writes it, in the order ``gene_ord``."""
        return annotate_expression(self.genes, self.expression).select(
            "gene_id", F.concat(F.lit("chr"), "contig").alias("chr_n"),
            F.expr("case when strand = '+' then g_start else g_end end").alias("pos0"), "biotype",
            "fold_change", F.expr("cast(substring(gene_id, 2) as bigint)").alias("gene_ord"),
        )
