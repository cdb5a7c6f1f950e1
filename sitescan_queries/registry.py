"""One registered query per operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitescan import operators as ops
from sitescan import sources as io
from sitescan.defaults import CORE_WORDS
from sitescan.functions import (
    contig, direction_label, fasta_id, gene_origin, parse_number, revcomp, signed_fold_change, split_ids,
)
from sitescan.plans import cooccupancy, fasta_records, filtered_sites, generate
from sitescan.plans.generate import window_overlap
from sitescan.session import scratch_path
from sitescan_queries.views import DIST, DIST_ORIGIN, DIST_SITES, MULT, OVERLAP, Views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
    return fn


def _r6(col: str):
    return F.round(F.col(col), 6).alias(col)


def _located(v: Views, **kwargs) -> DataFrame:
    return ops.locate_sites(v.peaks, v.contigs, **kwargs)


# --- sources and sinks: written to the shared folder from the given tables and read back ---------------


@query
def s1_bed_scan(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "bed")
    io.write_bed(v.peaks.select("chr_n", "pos_ini", "pos_end", F.col("peak_id").alias("name")), path)
    return io.read_bed(v.spark, path, n_cols=4)


@query
def s2_table_scan(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "sites")
    io.write_table(v.sites, path)
    return io.read_table(v.spark, path).select(
        F.col("site_id").cast("bigint").alias("site_id"), "chr_n", F.col("pos_ini").cast("bigint").alias("pos_ini"),
        F.col("pos_end").cast("bigint").alias("pos_end"), "seq", "source", "score_pssm",
    )


@query
def s3_genes_scan(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "genes")
    io.write_table(v.gene_table.drop("gene_ord"), path)
    return io.read_genes(v.spark, path).select("gene_id", "chr_n", "pos0", "biotype", _r6("fold_change"))


@query
def s4_expression_scan(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "expression")
    io.write_table(
        v.raw_expression.select(
            F.col("raw_id").alias("id"), "gene_name", F.col("row_ord").alias("n"),
            F.col("raw_value").alias("log2fc"), "row_ord",
        ),
        path, order_by=["row_ord"], drop=["row_ord"],
    )
    return io.read_expression(v.spark, path).select("gene_id", _r6("fold_change"))


def _fasta_path(v: Views) -> str:
    path = scratch_path(v.spark, "fasta")
    lines = F.regexp_replace("seq", "(.{60})", "$1\n")
    io.write_fasta(v.seqs.select(F.concat("chr_n", F.lit(" a record")).alias("id"), lines.alias("seq")), path)
    return path


@query
def s5_fasta_scan(v: Views) -> DataFrame:
    return io.read_fasta(v.spark, _fasta_path(v))


@query
def s5_fasta_chunks(v: Views) -> DataFrame:
    chunks = io.read_fasta_chunks(v.spark, _fasta_path(v), size=1000, overlap=OVERLAP)
    return chunks.select("chr_n", "chunk_id", "chunk_start", "chunk_len", F.col("bases").cast("string").alias("bases"))


@query
def s6_chromosome_pruning(v: Views) -> DataFrame:
    return ops.split_by_sequence(v.seqs, v.peaks)[0].select("chr_n", F.length("seq").cast("bigint").alias("n"))


@query
def s7_motif_log_odds(v: Views) -> DataFrame:
    return v.motifs.select("motif", F.col("pos").cast("bigint").alias("pos"), "base", "count", _r6("log_odds"))


@query
def s7_without_pseudocount(v: Views) -> DataFrame:
    """A base that was never counted cannot occur: its log-odds are minus infinity."""
    counts = v.motif_counts.where("not (base = 'A' and pos % 2 = 0)")
    odds = ops.motif_log_odds(counts, pseudocount=0.0).select("motif", F.col("pos").cast("bigint").alias("pos"), "base", "log_odds")
    return odds.select(
        "motif", "pos", "base", F.round(F.when(F.col("log_odds") > float("-inf"), F.col("log_odds")), 6).alias("log_odds"),
        (F.col("log_odds") == float("-inf")).alias("impossible"),
    )


@query
def s8_motif_files(v: Views) -> DataFrame:
    """Two motifs per file: the second one is left out."""
    path = scratch_path(v.spark, "motifs")
    row = v.motifs.groupBy("motif", "pos").agg(
        *[F.max(F.when(F.col("base") == b, F.col("count").cast("string"))).alias(b) for b in "ACGT"]
    ).select("motif", "pos", F.concat_ws("\t", "A", "C", "G", "T").alias("_line"))
    body = row.groupBy("motif").agg(F.expr("listagg(_line, '\n') within group (order by pos)").alias("_body"))
    text = F.concat(F.lit(">"), "motif", F.lit("\n"), "_body", F.lit("\n>second\n9 0 0 0\n0 9 0 0"))
    body.select("motif", text.alias("value")).write.partitionBy("motif").text(path)
    counts = io.read_motif_counts(v.spark, path + "/*")
    return counts.select(
        F.regexp_extract("motif", "^motif=([^/]+)/", 1).alias("motif"), F.col("pos").cast("bigint").alias("pos"),
        "base", "count",
    )


@query
def s9_annotation_scan(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "gtf")
    quoted = [
        F.concat(F.lit(f'{k} "'), F.col(c), F.lit('"'))
        for k, c in (("gene_id", "gene_id"), ("gene_name", "gene_name"), ("gene_biotype", "biotype"))
    ]
    gene = v.genes.select(
        "contig", F.lit("made").alias("src"), F.lit("gene").alias("feature"), "g_start", "g_end",
        F.lit(".").alias("score"), "strand", F.lit(".").alias("frame"),
        F.concat(F.concat_ws("; ", *quoted), F.lit(";")).alias("attributes"),
    )
    exon = gene.withColumn("feature", F.lit("exon")).withColumn("g_end", F.col("g_start") + 3)
    io.write_bed(gene.unionByName(exon), path)
    return io.read_annotation(v.spark, path)


@query
def k1_table_sink(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "peaks")
    io.write_table(v.peaks, path, order_by=["peak_id"])
    # Every part has the header, and how many parts there are is not part of the result.
    n = F.when(F.col("value") == "peak_id;chr_n;pos_ini;pos_end", F.lit(1)).otherwise(F.count(F.lit(1))).alias("n")
    return v.spark.read.text(path).groupBy("value").agg(n)


@query
def k2_fasta_sink(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "out")
    seqs = ops.extract_sequences(_located(v), v.chunks)
    io.write_fasta(seqs.select(F.col("peak_id").alias("ordinal"), F.col("peak_id").cast("string").alias("id"), "seq"), path)
    # Records are split at their ``>``, so ids and bases are read back together.
    records = v.spark.read.option("lineSep", ">").text(path).where("value <> ''")
    lines = F.split("value", "\n")
    return records.select(lines[0].alias("id"), lines[1].alias("seq"), F.size(lines).cast("bigint").alias("n_lines"))


# --- filters and projections ----------------------------------------------------------------------------


@query
def f1_rule_filter_exclude(v: Views) -> DataFrame:
    return ops.rule_filter(v.sites, [("source", "click"), (1, "chr0")], True).select("site_id", "chr_n", "source")


@query
def f1_rule_filter_include(v: Views) -> DataFrame:
    return ops.rule_filter(v.sites, [("source", "click"), (1, "chr0")], False).select("site_id", "chr_n", "source")


@query
def f2_project_sites(v: Views) -> DataFrame:
    return ops.project_sites(v.sites, [1, "pos_ini", 3], keep=["site_id"])


@query
def f3_blank_chromosome(v: Views) -> DataFrame:
    kept = ops.project_sites(v.sites, [1, 2, 3])
    return kept.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("chr_n").alias("n_named"),
        F.count_if(F.col("chr_n") == "").alias("n_blank"),
    )


@query
def f4_coding_genes(v: Views) -> DataFrame:
    coding, other = (
        ops.nearby_genes(v.peaks, v.genes, 0, **kind).groupBy("gene_id", "biotype").agg(F.count(F.lit(1)).alias("n"))
        for kind in ({}, {"biotype": "pseudogene"})
    )
    return coding.unionByName(other)


@query
def f5_sites_with_sequence(v: Views) -> DataFrame:
    return ops.split_by_sequence(v.peaks, v.lengths)[0]


@query
def f5_sites_without_sequence(v: Views) -> DataFrame:
    return ops.split_by_sequence(v.peaks, v.lengths)[1]


@query
def f6_skipped_count(v: Views) -> DataFrame:
    return ops.skipped_count(v.peaks, v.lengths)


@query
def f7_usable_expression_rows(v: Views) -> DataFrame:
    return ops.expression_rows(v.raw_expression).select("row_ord", "gene_id", _r6("fold_change"))


@query
def f8_genes_with_fold_change(v: Views) -> DataFrame:
    pairs = ops.genes_around(v.peaks, v.gene_table, DIST_ORIGIN, label_mode="signed")
    return pairs.groupBy("gene_id", "updown").agg(F.count(F.lit(1)).alias("n"))


# --- joins ------------------------------------------------------------------------------------------------


@query
def j1_nearby_genes(v: Views) -> DataFrame:
    return ops.nearby_genes(v.peaks, v.genes, DIST).select("peak_id", "chr_n", "gene_id", "pos0", "biotype")


@query
def j1_mixed_lengths(v: Views) -> DataFrame:
    """Peaks and genes of 10 to 2,000,000 bases, whose pairs grow with both: the peaks of a gene by sorted boundaries."""
    return ops.gene_peak_sums(v.long_peaks, v.long_genes, {"sum_id": F.col("peak_id")}, 1000, None)


@query
def j2_genes_with_expression(v: Views) -> DataFrame:
    return ops.annotate_expression(v.genes, v.expression).select("gene_id", "contig", _r6("fold_change"))


@query
def j3_translated_expression(v: Views) -> DataFrame:
    rows = ops.expression_rows(v.raw_expression)
    return ops.first_translated(rows, v.genes).select("gene_id", _r6("fold_change"))


@query
def j4_genes_around(v: Views) -> DataFrame:
    return ops.genes_around(v.peaks, v.gene_table, DIST_ORIGIN).select("peak_id", "gene_id", "updown", "gene_pos0")


@query
def j5_sequence_fetch(v: Views) -> DataFrame:
    return ops.extract_sequences(_located(v, clamp=True), v.chunks).select("peak_id", "seq")


@query
def j6_all_motifs_per_site(v: Views) -> DataFrame:
    hits = ops.scan_motifs(v.chunks, v.motifs, MULT)
    return ops.site_hits(_located(v), hits).groupBy("peak_id", F.col("hit_tf_name").alias("tf_name")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def j7_all_words_per_site(v: Views) -> DataFrame:
    hits = ops.scan_words(v.chunks, CORE_WORDS)
    return ops.site_hits(_located(v), hits).groupBy("peak_id", F.col("hit_ord").cast("bigint").alias("word_ord")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _generate(v: Views, contigs: DataFrame | None = None):
    """The views' intervals all end after their start. With ``contigs`` the sequences are left alone until needed."""
    return generate(
        v.peaks, v.genes, v.expression, v.chunks if contigs is None else lambda: v.chunks, CORE_WORDS, v.motifs, MULT,
        dist=DIST, contigs=contigs, ordered=True,
    )


@query
def j8_peak_context_on_hits(v: Views) -> DataFrame:
    return _generate(v).sites.groupBy("peak_id", "n_genes_near", "n_updown_total", "n_upreg", "n_downreg").agg(
        F.count(F.lit(1)).alias("n")
    )


def _cooccupancy(v: Views):
    return cooccupancy(
        v.sites, v.gene_table, v.chunks, v.motifs, ["M0", "M1", "M2"], DIST_SITES, DIST_ORIGIN, MULT,
    )


@query
def j9_hits_overlaid_by_site(v: Views) -> DataFrame:
    return _cooccupancy(v).other_tf.select(
        "site_id", "chr_n", "pos_ini", "pos_end", "seq", "source", "score_pssm", "hit_pos_ini", "hit_pos_end",
        "hit_seq",
    )


# --- aggregations, distinct, pivot ------------------------------------------------------------------------


@query
def a1_peak_gene_stats(v: Views) -> DataFrame:
    return ops.peak_gene_stats(v.peaks, ops.annotate_expression(v.genes, v.expression), DIST, ordered=True)


@query
def a2_peak_site_stats(v: Views) -> DataFrame:
    hits = ops.scan(v.chunks, CORE_WORDS, v.motifs, MULT)
    return ops.peak_site_stats(_located(v), hits, longest=max(map(len, CORE_WORDS)))


@query
def a3_distinct_genes(v: Views) -> DataFrame:
    pairs = ops.first_peaks(v.peaks, ops.annotate_expression(v.genes, v.expression), "peak_id", DIST)
    return ops.distinct_genes(pairs, "peak_id").select("gene_id", "chr_n", "pos0", "biotype", _r6("fold_change"))


@query
def a4_distinct_chromosomes(v: Views) -> DataFrame:
    return v.peaks.select("chr_n").distinct()


@query
def a5_first_fold_change(v: Views) -> DataFrame:
    return v.expression.select("gene_id", _r6("fold_change"))


@query
def a6_expression_conflicts(v: Views) -> DataFrame:
    return ops.expression_conflicts(ops.expression_rows(v.raw_expression)).select(
        "gene_id", _r6("fold_change"), "n_conflicts"
    )


@query
def a6_translated_conflicts(v: Views) -> DataFrame:
    rows = ops.translate_names(ops.expression_rows(v.raw_expression), v.genes)
    return ops.expression_conflicts(rows).select("gene_id", _r6("fold_change"), "n_conflicts")


@query
def a7_gene_string(v: Views) -> DataFrame:
    return ops.gene_string(v.peaks, v.gene_table, DIST_ORIGIN, key="peak_id").select("peak_id", "str_genes_rnaseq_near")


@query
def a8_cooccupancy_flags(v: Views) -> DataFrame:
    hits = ops.scan_motifs(v.chunks, v.motifs, MULT)
    names = ["M0", "M1", "M2", "absent"]
    return ops.cooccupancy_flags(_located(v), hits, names, key="peak_id", longest=7).select("peak_id", *names)


@query
def a9_expression_summary(v: Views) -> DataFrame:
    return ops.expression_summary(v.raw_expression)


@query
def a9_translated_summary(v: Views) -> DataFrame:
    return ops.expression_summary(v.raw_expression, v.genes)


@query
def a10_motif_cutoffs(v: Views) -> DataFrame:
    return ops.motif_cutoffs(v.motifs, 0.9).select("motif", _r6("max_score"), _r6("cutoff"))


@query
def a11_score_report(v: Views) -> DataFrame:
    return ops.motif_cutoffs(v.motifs, MULT).select("motif", F.round("max_score", 4).alias("max_score"), F.round("cutoff", 4).alias("cutoff"))


# --- window-shaped ------------------------------------------------------------------------------------------


@query
def w1_row_ordinal(v: Views) -> DataFrame:
    """All rows, in an order unrelated to the one they are stored in."""
    scrambled = v.sites.withColumn("place", F.expr("site_id * 7919 % 1000003 * 1000000 + site_id"))
    return ops.with_ordinal(scrambled, "place").select("site_id", "ordinal")


@query
def w2_kmer_windows(v: Views) -> DataFrame:
    return ops.kmers(v.chunks, 6).groupBy("kmer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start")
    )


@query
def w2_long_windows(v: Views) -> DataFrame:
    """Windows of 31 bases, nearly all different: how many of them occur how often."""
    counted = ops.count_kmers(v.chunked(30), 31)
    return counted.groupBy("n").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("sum_start").alias("sum_start"))


@query
def w3_first_row_per_key(v: Views) -> DataFrame:
    return ops.first_per_key(v.peaks, ["chr_n"], "peak_id")


# --- sort, sample, set operations ---------------------------------------------------------------------------


@query
def o1_sample_peaks(v: Views) -> DataFrame:
    return ops.sample_peaks(v.peaks, 100, seed=7)


@query
def o2_hit_order(v: Views) -> DataFrame:
    """Place of each hit within its peak when the sites are written: words, then motifs."""
    from pyspark.sql import Window

    from sitescan.plans.generate import site_order

    sites = _generate(v).sites
    place = F.row_number().over(Window.partitionBy("peak_id").orderBy(*site_order()[1:])).cast("bigint")
    return sites.select("peak_id", "source", "pos_ini", "seq", place.alias("place"))


@query
def o3_union_of_hits(v: Views) -> DataFrame:
    words = ops.scan_words(v.chunks, CORE_WORDS)
    motifs = ops.scan_motifs(v.chunks, v.motifs, MULT)
    return words.unionByName(motifs).groupBy("chr_n", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start")
    )


# --- scalar and sequence operators ------------------------------------------------------------------------


@query
def x1_extract_sequences(v: Views) -> DataFrame:
    return ops.extract_sequences(_located(v), v.chunks).select("peak_id", "seq")


@query
def x2_resize_sites(v: Views) -> DataFrame:
    return ops.resize_sites(v.peaks, 125)


@query
def x3_expand_sites(v: Views) -> DataFrame:
    return ops.expand_sites(v.peaks, DIST_SITES)


@query
def x4_reverse_complement(v: Views) -> DataFrame:
    return v.seqs.select("chr_n", revcomp("seq").alias("seq"))


@query
def x5_word_scan(v: Views) -> DataFrame:
    return ops.scan_words(v.chunks, CORE_WORDS).select(
        "chr_n", "start", "seq", "strand", F.col("hit_ord").cast("bigint").alias("word_ord")
    )


def _words_of(v: Views, length: int) -> DataFrame:
    """The first bases of the sequences, as far as they are ACGT alone."""
    return v.seqs.select(F.upper(F.substring("seq", 1, length)).alias("w")).where(
        F.rlike("w", F.lit(f"^[ACGT]{{{length}}}$"))
    ).distinct()


def _word_counts(chunks: DataFrame, words: list[str]) -> DataFrame:
    return ops.count_word_hits(chunks, words).withColumn("hit_ord", F.col("hit_ord").cast("bigint")).withColumnRenamed("hit_ord", "word_ord")


@query
def x5_many_words(v: Views) -> DataFrame:
    """Every word of eight bases that begins a sequence: about as many words as there are sequences."""
    words = sorted(r.w for r in _words_of(v, 8).collect())  # at most 4**8
    return _word_counts(v.chunks, words)


@query
def x5_mixed_words(v: Views) -> DataFrame:
    """The words of five to eight bases that begin the sequences; each sequence's length picks its word's."""
    begins = F.upper(F.expr("substring(seq, 1, cast(5 + length(seq) % 4 as int))"))
    some = v.seqs.select(begins.alias("w")).where(F.rlike("w", F.lit("^[ACGT]{5,}$"))).distinct()
    return _word_counts(v.chunks, sorted(r.w for r in some.collect()))  # at most 4**5 + ... + 4**8


@query
def x5_long_word(v: Views) -> DataFrame:
    """The greatest word of 80 bases that begins a sequence; the chunks overlap by 79 for it."""
    word = _words_of(v, 80).agg(F.max("w")).first()[0]
    return _word_counts(v.chunked(window_overlap([word]), 1000), [word])


@query
def x6_motif_scan(v: Views) -> DataFrame:
    return ops.scan_motifs(v.chunks, v.motifs, MULT).select(
        "chr_n", "start", "seq", "strand", "tf_name", _r6("score_pssm")
    )


@query
def x6_many_motifs(v: Views) -> DataFrame:
    """A motif for every supplier, in one pass over the bases."""
    return ops.count_motif_hits(v.chunks, ops.motif_log_odds(v.many_motif_counts), 0.9)


@query
def x7_panel_scan_around_sites(v: Views) -> DataFrame:
    hits = ops.scan_motifs(v.chunks, v.motifs, MULT)
    wide = ops.locate_sites(
        ops.expand_sites(v.peaks, DIST_SITES), v.contigs, "search_ini", "search_end"
    )
    return ops.site_hits(wide, hits).select(
        "peak_id", "hit_pos_ini", "hit_pos_end", "hit_seq", "hit_tf_name", _r6("hit_score")
    )


@query
def x8_length_guard(v: Views) -> DataFrame:
    """Windows longer than most sequences: short sequences give none."""
    return ops.kmers(v.chunked(1999), 2000).groupBy("chr_n").agg(F.count(F.lit(1)).alias("n_windows"))


@query
def t1_signed_fold_change(v: Views) -> DataFrame:
    return v.raw_expression.select(
        "row_ord", F.round(signed_fold_change(parse_number("raw_value")), 6).alias("fold_change")
    ).where("fold_change is not null")


@query
def t2_split_ids(v: Views) -> DataFrame:
    return v.raw_expression.select("row_ord", F.explode(split_ids("raw_id")).alias("gene_id"))


@query
def t3_contig_name(v: Views) -> DataFrame:
    return v.peaks.select("peak_id", contig("chr_n").alias("contig"))


@query
def t4_gene_origin(v: Views) -> DataFrame:
    return v.genes.select("gene_id", gene_origin("strand", "g_start", "g_end").alias("pos0"))


@query
def t5_direction_label(v: Views) -> DataFrame:
    return v.gene_table.select("gene_id", direction_label("fold_change").alias("updown"))


@query
def t6_fasta_id(v: Views) -> DataFrame:
    return v.peaks.select(fasta_id(F.col("peak_id") + 1, "chr_n", "pos_ini", "pos_end").alias("id"))


@query
def t7_forward_coordinates(v: Views) -> DataFrame:
    hits = ops.scan_motifs(v.chunks, v.motifs, MULT)
    return ops.site_hits(_located(v), hits).select("peak_id", "hit_strand", "hit_pos_ini", "hit_pos_end", "hit_tf_name")


# --- composite jobs -----------------------------------------------------------------------------------------


@query
def p1_generate_peaks(v: Views) -> DataFrame:
    return _generate(v).peaks


@query
def p1_generate_sites(v: Views) -> DataFrame:
    return _generate(v).sites.select(
        "peak_id", "chr_n", "pos_ini", "pos_end", "seq", "source", _r6("score_pssm"), "n_genes_near",
        "n_updown_total", "n_upreg", "n_downreg",
    )


@query
def p1_generate_genes(v: Views) -> DataFrame:
    return _generate(v, v.lengths).genes.select("gene_id", "chr_n", "pos0", "biotype", _r6("fold_change"))


@query
def p1_gene_order(v: Views) -> DataFrame:
    """The genes table in its written order, given to the gene strings of the sites."""
    genes = ops.with_ordinal(_generate(v, v.lengths).genes, "gene_ord", "place").withColumnRenamed("place", "gene_ord")
    return ops.gene_string(v.peaks, genes, DIST_ORIGIN, key="peak_id").select("peak_id", "str_genes_rnaseq_near")


def _counts(v: Views, counts: dict[str, int]) -> DataFrame:
    return v.spark.createDataFrame([(counts["n_sites"], counts["n_skipped"])], "n_sites bigint, n_skipped bigint")


@query
def p1_skipped_peaks(v: Views) -> DataFrame:
    """Peaks without a sequence, counted by the pass that locates the others."""
    tables = generate(
        v.peaks, v.genes, v.expression, lambda: v.chunks, contigs=v.lengths, dist=DIST, materialize=True, ordered=True
    )
    return _counts(v, tables.counts)


@query
def p2_skipped_sites(v: Views) -> DataFrame:
    """Sites that the export leaves out, counted while it reads the others."""
    seen = Observation("export")
    kept = filtered_sites(v.sites, "site_id", [("source", "click")], True, [1, 2, 3], 120)
    fasta_records(kept, v.chunks, seen=seen)
    return _counts(v, seen.get)


@query
def p2_fasta_export(v: Views) -> DataFrame:
    kept = filtered_sites(v.sites, "site_id", [("source", "click")], True, [1, 2, 3], 120)
    return fasta_records(kept, v.chunks).select("id", "seq")


@query
def p3_cooccupancy_sites(v: Views) -> DataFrame:
    flags = [F.col(n).cast("bigint").alias(n) for n in ("M0", "M1", "M2")]
    return _cooccupancy(v).sites.select(
        "site_id", "chr_n", "pos_ini", "pos_end", "seq", "source", "score_pssm", "str_genes_rnaseq_near", *flags
    )


@query
def p3_skipped_sites(v: Views) -> DataFrame:
    return _cooccupancy(v).skipped


@query
def p3_cooccupancy_hits(v: Views) -> DataFrame:
    return _cooccupancy(v).other_tf.select(
        "site_id", "chr_n", "pos_ini", "seq", "source", "score_pssm", "tf_name", "str_genes_rnaseq_near",
        *[F.col(n).cast("bigint").alias(n) for n in ("M0", "M1", "M2")],
        "hit_pos_ini", "hit_pos_end", "hit_seq", _r6("hit_score"),
    )
