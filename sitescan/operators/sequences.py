"""Sequences as a chunk table.

A chunk row ``(chr_n, chunk_id, chunk_start, chunk_len, bases BINARY)`` owns ``chunk_len`` bases from
``chunk_start`` (0-based) and carries ``overlap`` more, so a window that starts in it can be read without
its neighbour. Chunks spread a long chromosome over the cluster; ``bases`` is binary because a substring
of a Spark string walks from its first character. An empty sequence is one chunk without bases, so it stays
a contig of length 0. Size and overlap stand in the metadata of the column ``chunk_id`` and are stored with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sitescan.defaults import CHUNK_OVERLAP, CHUNK_SIZE
from sitescan.operators.grouping import per_row


def with_layout(chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """The chunk table with its size and overlap noted on ``chunk_id``."""
    return chunks.withMetadata("chunk_id", {"chunk_size": size, "chunk_overlap": overlap})


def chunk_layout(chunks: DataFrame, size: int | None = None) -> tuple[int, int]:
    """(size, overlap) of a chunk table; a ``size`` the caller expects must agree."""
    noted = chunks.schema["chunk_id"].metadata
    if "chunk_size" not in noted:
        raise ValueError("this chunk table doesn't tell its size; make it with chunk_sequences or with_layout")
    if size is not None and size != noted["chunk_size"]:
        raise ValueError(f"the chunks are {noted['chunk_size']} bases long, not {size}")
    return noted["chunk_size"], noted["chunk_overlap"]


def chunk_sequences(seqs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(chr_n, seq) -> chunk table; map-only, the long value never crosses a shuffle."""
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    raw = seqs.select("chr_n", F.col("seq").cast("binary").alias("_raw")).withColumn(
        "_n", F.octet_length("_raw").cast("bigint")
    )
    last = F.greatest(F.col("_n") - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("bigint"), last, F.lit(size).cast("bigint"))
    return with_layout(
        raw.select("chr_n", "_raw", "_n", F.posexplode(starts).alias("chunk_id", "chunk_start"))
        .select(
            "chr_n",
            F.col("chunk_id").cast("bigint").alias("chunk_id"),
            "chunk_start",
            F.least(F.lit(size).cast("bigint"), F.col("_n") - F.col("chunk_start")).alias("chunk_len"),
            F.substring("_raw", (F.col("chunk_start") + 1).cast("int"), F.lit(size + overlap)).alias("bases"),
        ),
        size, overlap,
    )


def contig_lengths(chunks: DataFrame) -> DataFrame:
    """(chr_n, contig_len), one row per sequence; reads no bases from a stored chunk table."""
    return chunks.groupBy("chr_n").agg(F.max(F.col("chunk_start") + F.col("chunk_len")).alias("contig_len"))


def locate_sites(
    sites: DataFrame,
    contigs: DataFrame,
    pos_ini: str = "pos_ini",
    pos_end: str = "pos_end",
    clamp: bool = False,
    seen: Observation | None = None,
) -> DataFrame:
    """Sites on a known contig with the slice they cut from it.

    Adds ``slice_ini`` (0-based), ``slice_end`` (exclusive) and ``slice_shift``, the difference between a
    reported and a true coordinate. Positions are 1-based inclusive. By default a start below 1 counts from
    the end of the contig, as a negative slice index does, which is normally empty; ``clamp=True`` cuts at
    the first base instead. ``seen`` receives ``n_sites`` and ``n_skipped``, the sites on no known contig, when the
    result is first computed: the counts take no pass of their own.
    """
    n = F.col("contig_len")
    start0 = F.col(pos_ini).cast("bigint") - 1
    end0 = F.col(pos_end).cast("bigint")
    wrapped_end = F.when(end0 < 0, F.greatest(n + end0, F.lit(0))).otherwise(F.least(end0, n))
    if clamp:
        slice_ini, slice_end, shift = F.greatest(start0, F.lit(0)), F.least(end0, n), F.lit(0).cast("bigint")
    else:
        slice_ini = F.when(start0 < 0, F.greatest(n + start0, F.lit(0))).otherwise(start0)
        slice_end, shift = wrapped_end, start0 - slice_ini
    known = contigs.select("chr_n", "contig_len")
    if seen is None:
        placed = sites.join(known, "chr_n")
    else:
        lost = F.count_if(F.col("contig_len").isNull())
        placed = sites.join(known, "chr_n", "left").observe(
            seen, F.count(F.lit(1)).alias("n_sites"), lost.alias("n_skipped")
        ).where("contig_len is not null")
    return (
        placed
        .select(
            *[F.col(f"`{c}`") for c in sites.columns],
            slice_ini.alias("slice_ini"),
            F.greatest(slice_end, slice_ini).alias("slice_end"),
            shift.alias("slice_shift"),
        )
    )


SLICE_COLUMNS = ("slice_ini", "slice_end", "slice_shift")


def _chunk_ids(size: int) -> Column:
    first = F.floor(F.col("slice_ini") / size)
    last = F.floor((F.col("slice_end") - 1) / size)
    return F.when(F.col("slice_end") > F.col("slice_ini"), F.sequence(first, last))


def prune_chunks(chunks: DataFrame, located: DataFrame, size: int | None = None) -> DataFrame:
    """Chunks some site touches, each once, however many sites share it.

    The distinct keys combine map-side, so a hot locus costs one key per task.
    """
    ids = _chunk_ids(chunk_layout(chunks, size)[0])
    touched = per_row(located.select("chr_n", F.explode(ids).alias("chunk_id")), ["chr_n", "chunk_id"])
    touched = touched.select(F.col("chr_n").alias("_chr"), F.col("chunk_id").alias("_cid"))
    return chunks.join(touched, (F.col("chr_n") == F.col("_chr")) & (F.col("chunk_id") == F.col("_cid")), "left_semi")


def extract_sequences(located: DataFrame, chunks: DataFrame, size: int | None = None) -> DataFrame:
    """Located sites with their bases in ``seq``; an empty slice gives an empty string.

    ``located`` needs a column that makes its rows unique. A site inside one chunk (its overlap counts) is cut
    right after the join. Only a site over several chunks is put together again, in chunk order; chunks meet
    at their own ends, so no base comes twice.
    """
    size, overlap = chunk_layout(chunks, size)
    columns = [F.col(f"`{k}`") for k in located.columns]
    first = F.floor(F.col("slice_ini") / size)
    spans = (F.col("slice_end") > F.col("slice_ini")) & (F.col("slice_end") > (first + 1) * size + overlap)
    side = chunks.select(
        F.col("chr_n").alias("_chr"), F.col("chunk_id").alias("_cid"),
        F.col("chunk_start").alias("_start"), F.col("chunk_len").alias("_len"), "bases",
    )
    # Sites over several chunks have a row for each; the others one, also when their slice is empty.
    parts = F.when(spans, _chunk_ids(size)).otherwise(F.array(first))
    pieces = located.select(*columns, spans.alias("_spans"), F.explode(parts).alias("_chunk")).join(
        side, (F.col("chr_n") == F.col("_chr")) & (F.col("_chunk") == F.col("_cid")), "left"
    )
    lo = F.greatest(F.col("slice_ini"), F.col("_start"))
    hi = F.when(F.col("_spans"), F.least(F.col("slice_end"), F.col("_start") + F.col("_len"))).otherwise(F.col("slice_end"))
    piece = F.when(hi > lo, F.substring("bases", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")))
    whole = pieces.where(~F.col("_spans")).select(*columns, piece.alias("_seq"))
    joined = per_row(
        pieces.where("_spans").select(*columns, "_chunk", piece.alias("_piece")), located.columns,
        F.expr("listagg(_piece, X'') within group (order by _chunk)").alias("_seq"),
    )
    return whole.unionByName(joined).select(*columns, F.coalesce(F.col("_seq").cast("string"), F.lit("")).alias("seq"))


def kmers(chunks: DataFrame, k: int) -> DataFrame:
    """(chr_n, start, kmer): every window of ``k`` bases, ``start`` 0-based; nothing for shorter sequences."""
    check_window(k, chunk_layout(chunks)[1])
    last = F.least(F.col("chunk_len"), F.octet_length("bases") - (k - 1)).cast("int")
    return (
        chunks.where((F.octet_length("bases") >= k) & (F.col("chunk_len") > 0))
        .select("chr_n", "chunk_start", "bases", F.explode(F.sequence(F.lit(1), last)).alias("_i"))
        .select(
            "chr_n",
            (F.col("chunk_start") + F.col("_i") - 1).alias("start"),
            F.substring("bases", F.col("_i"), F.lit(k)).cast("string").alias("kmer"),
        )
    )


def check_window(k: int, overlap: int) -> None:
    """A window may not reach past the bases its chunk carries."""
    if k < 1:
        raise ValueError("an empty word or motif would match everywhere")
    if k > overlap + 1:
        raise ValueError(f"window of {k} bases needs chunks with an overlap of {k - 1} or more, not {overlap}")
