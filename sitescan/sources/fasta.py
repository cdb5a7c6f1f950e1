"""FASTA, read split by split: no task ever holds a whole chromosome.

Each task joins the lines of its file splits to pieces, in the order they lie in, and the splits of a file are
chained through one small summary row each. The bases cross one shuffle, to their chunks. A packed (gzip) file
is one split: unpack large genomes, or keep one file per chromosome.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitescan.defaults import CHUNK_OVERLAP, CHUNK_SIZE
from sitescan.operators.sequences import with_layout
from sitescan.session import cut_lineage


#: Bases of a piece: lines of a split are joined up to about this size before they leave their task.
PIECE = 1 << 16


def _pieces_of(rows: Iterator[tuple], piece: int) -> Iterator[tuple]:
    """(file, block, row, title, name, head, cum, n, bases) of the lines of a task, which come in file order.

    Lines are (file, block, bytes, name that the file gives to its record, if it does). A head line is a row of
    its own, with its title and no bases; the lines up to the next one are joined to pieces, a long line is cut
    into several. ``cum`` counts the bases of the split up to the row's end, ``head`` those up to the last head line, and
    ``name`` is that line's title.
    """
    split, name, head, total, row, held, size = None, None, None, 0, 0, [], 0

    def flush():
        nonlocal total, row, held, size
        bases = b"".join(b"".join(held).split())
        held, size = [], 0
        for at in range(0, len(bases), piece):
            part = bases[at:at + piece]
            total, row = total + len(part), row + 1
            yield (*split, row, None, name, head, total, len(part), part)

    for file, block, line, own in rows:
        if (file, block) != split:
            yield from flush()
            split, name, head, total, row = (file, block), None, None, 0, 0
        if line.startswith(b">"):
            yield from flush()
            name = _TITLE.match(line)[1].decode("utf-8", "replace") if own is None else own
            head, row = total, row + 1
            yield (*split, row, name, name, head, total, 0, None)
            continue
        held.append(line)
        size += len(line)
        if size >= piece:
            yield from flush()
    yield from flush()


_TITLE = re.compile(rb">\s*(\S*)")
_KINDS = pa.schema([
    ("_file", pa.int64()), ("_block", pa.int64()), ("_row", pa.int64()), ("_title", pa.string()), ("_name", pa.string()),
    ("_head", pa.int64()), ("_cum", pa.int64()), ("n", pa.int64()), ("bases", pa.binary()),
])


def _lines(spark: SparkSession, path: str, genome: str | None, piece: int = PIECE) -> DataFrame:
    """(chr_n, offset, n, bases): the bases in pieces, each with its 0-based offset in its record; the head line,
    whose ``bases`` are null, comes with offset 0, so a record without bases is there too."""
    own = F.lit(None).cast("string")
    if genome is not None:
        own = F.regexp_extract(F.col("_metadata.file_name"), rf"^\Q{genome}\E_(.+)\.fasta$", 1)
    source = spark.read.text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"), own.alias("own"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        made, size = [], 0
        for out in _pieces_of(rows, piece):
            made.append(out)
            size += 100 + out[7]
            if size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), _KINDS.types)], schema=_KINDS)
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), _KINDS.types)], schema=_KINDS)

    cloudpickle.register_pickle_by_value(sys.modules["sitescan"])
    # Stored once, as they lie in the files: nothing is shuffled here.
    lines = cut_lineage(source.mapInArrow(run, (
        "_file bigint, _block bigint, _row bigint, _title string, _name string, _head bigint, _cum bigint, n bigint, bases binary"
    )))
    summary = lines.groupBy("_file", "_block").agg(
        F.sum("n").alias("_total"),
        F.max_by("_name", "_row").alias("_last_name"),
        F.max("_head").alias("_last_head"),
        F.count("_title").alias("_heads"),
    )
    # One row per file split (128 MB by default).
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_file")
    chained = (
        summary.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .withColumn("_carried", F.last("_last_name", True).over(before))
        .withColumn("_carried_head", F.last(F.col("_base") + F.col("_last_head"), True).over(before))
        .withColumn("_heads", F.sum("_heads").over(whole))
    )
    if genome is not None:
        # One record per file is required in this layout; other files count as missing.
        chained = chained.where(F.col("_heads") == 1)
    here = F.col("_base") + F.col("_cum") - F.col("n")
    record = F.coalesce(F.col("_base") + F.col("_head"), F.col("_carried_head"))
    return (
        lines.join(
            chained.select("_file", "_block", "_base", "_carried", "_carried_head"), ["_file", "_block"]
        )
        .where((F.col("n") > 0) | F.col("bases").isNull())
        .select(
            F.coalesce("_name", "_carried").alias("chr_n"), (here - record).alias("offset"), "n", "bases"
        )
        .where((F.col("chr_n") != "") & F.col("offset").isNotNull())
    )


def read_fasta_chunks(
    spark: SparkSession, path: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    genome: str | None = None,
) -> DataFrame:
    """FASTA file or directory -> chunk table.

    A record is called after the first word of its ``>`` line. With ``genome`` the files follow the
    one-record-per-chromosome layout ``<genome>_<chr>.fasta`` and the name comes from the file.
    Two records of one name end the job with an error; a record without bases is one empty chunk.
    """
    first = F.greatest(F.floor((F.col("offset") - overlap) / size), F.lit(0))
    last = F.greatest(F.floor((F.col("offset") + F.col("n") - 1) / size), first)
    begin = F.col("chunk_id") * size
    lo = F.greatest(F.col("offset"), begin)
    hi = F.least(F.col("offset") + F.col("n"), begin + size + overlap)
    head = F.col("bases").isNull()
    pieces = (
        _lines(spark, path, genome)
        .withColumn("chunk_id", F.explode(F.sequence(first, last)))
        .where((hi > lo) | head)
        .select(
            "chr_n", "chunk_id", lo.alias("_lo"), head.cast("int").alias("_head"),
            F.coalesce(
                F.substring("bases", (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int")), F.lit(b"")
            ).alias("_piece"),
        )
    )
    start = (F.col("chunk_id") * size).cast("bigint")
    grouped = pieces.groupBy("chr_n", "chunk_id").agg(
        F.expr("listagg(_piece, X'') within group (order by _lo)").alias("_bases"), F.sum("_head").alias("_heads")
    )
    bases = F.when(F.col("_heads") > 1, _twins()).otherwise(F.col("_bases"))
    # Made from the checked bases, so that a read of the lengths alone meets the check too.
    return with_layout(
        grouped.select("chr_n", F.col("chunk_id").cast("bigint").alias("chunk_id"), start.alias("chunk_start"), bases.alias("bases"))
        .select(
            "chr_n", "chunk_id", "chunk_start",
            F.least(F.lit(size), F.octet_length("bases")).cast("bigint").alias("chunk_len"), "bases",
        ),
        size, overlap,
    )


def _twins() -> Column:
    return F.raise_error(F.concat(F.lit("more than one FASTA record is called "), F.col("chr_n"))).cast("binary")


def read_fasta(spark: SparkSession, path: str, genome: str | None = None) -> DataFrame:
    """(chr_n, seq), one row per record: a helper for records that fit in a row (less than 2 GB). The jobs use
    ``read_fasta_chunks``."""
    grouped = _lines(spark, path, genome).groupBy("chr_n").agg(
        F.expr("listagg(coalesce(bases, X''), X'') within group (order by offset)").alias("_bases"),
        F.count_if(F.col("bases").isNull()).alias("_heads"),
    )
    return grouped.select("chr_n", F.when(F.col("_heads") > 1, _twins()).otherwise(F.col("_bases")).cast("string").alias("seq"))
