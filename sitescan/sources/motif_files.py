"""Count-matrix files: four numbers (A C G T) per line, optional ``>name`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitescan.defaults import BACKGROUND, PSEUDOCOUNT
from sitescan.operators.motifs import BASES, motif_log_odds


def read_motif_counts(
    spark: SparkSession, path: str, first_only: bool = True, names: dict[str, str] | None = None
) -> DataFrame:
    """(motif, motif_ord, pos, base, count) from a file or a directory of files.

    A motif is called after its file (``names`` maps files to display names; their order in ``names`` is then
    the motif order, else the file name's); further motifs of one file, kept with ``first_only=False``, add
    the text of their ``>`` line. A file without any motif is an error.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value")
    )
    if names:
        files = files.where(F.col("file").isin(list(names)))
    lines = files.select(
        "path", "file", F.posexplode(F.split("value", r"\r?\n|\r")).alias("_line", "_raw")
    ).select("path", "file", "_line", F.trim(F.regexp_replace("_raw", r"\s+", " ")).alias("_text"))
    head = F.col("_text").startswith(">")
    cells = F.split("_text", " ")
    # A numbered line carries its position first.
    cells = F.when(F.size(cells) == 5, F.slice(cells, 2, 4)).otherwise(cells)
    numbers = F.transform(cells, lambda c: c.try_cast("double"))
    # Windows within one small text file.
    seen = Window.partitionBy("path").orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parsed = (
        lines.where((F.col("_text") != "") & ~F.col("_text").startswith("#"))
        .withColumn("_head", F.sum(head.cast("int")).over(seen))
        .withColumn("_title", F.last(F.when(head, F.trim(F.expr("substr(_text, 2)"))), True).over(seen))
        .where(~head)
        .withColumn("_n", numbers)
        .where((F.size("_n") == 4) & F.forall("_n", lambda x: x.isNotNull()))
    )
    order = Window.partitionBy("path").orderBy("_head")
    ranked = (
        parsed.withColumn("_k", F.dense_rank().over(order) - 1)
        .withColumn("pos", F.row_number().over(Window.partitionBy("path", "_head").orderBy("_line")) - 1)
    )
    _require_motifs(files, ranked)
    if first_only:
        ranked = ranked.where(F.col("_k") == 0)
    # Files of equal name in different folders are told apart by the folder.
    twins = F.size(F.collect_set("path").over(Window.partitionBy("file"))) > 1
    shown = F.when(twins, F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)).otherwise(F.col("file"))
    rank_by: list = ["file", "path", "_k"]
    if names:
        shown = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("file")]
        place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
        rank_by = [place[F.col("file")], "path", "_k"]
    title = F.when(F.col("_k") == 0, shown).otherwise(F.concat(shown, F.lit(":"), F.col("_title")))
    # The distinct motifs are ranked, not their cells.
    each = ranked.groupBy("file", "path", "_k").agg(F.lit(1).alias("_one"))
    places = each.select(
        F.col("path").alias("_path"), F.col("_k").alias("_which"),
        (F.row_number().over(Window.orderBy(*rank_by)) - 1).alias("motif_ord"),
    )
    ranked = ranked.withColumn("_shown", F.coalesce(title, F.concat(shown, F.lit(":"), F.col("_k"))))
    return ranked.join(places, (F.col("path") == F.col("_path")) & (F.col("_k") == F.col("_which"))).select(
        F.col("_shown").alias("motif"), "motif_ord", F.col("pos"),
        F.posexplode("_n").alias("_b", "count"),
    ).select("motif", "motif_ord", "pos", F.element_at(F.array(*map(F.lit, BASES)), F.col("_b") + 1).alias("base"), "count")


def _require_motifs(files: DataFrame, parsed: DataFrame) -> None:
    empty = files.select("path").join(parsed.select("path").distinct(), "path", "left_anti").limit(5).collect()
    if empty:
        raise ValueError(f"no motif found in {[r['path'] for r in empty]}")


def read_motifs(
    spark: SparkSession, path: str, pseudocount: float = PSEUDOCOUNT, background: float = BACKGROUND,
    first_only: bool = True, names: dict[str, str] | None = None,
) -> DataFrame:
    """(motif, motif_ord, pos, base, count, log_odds)."""
    return motif_log_odds(read_motif_counts(spark, path, first_only, names), pseudocount, background)
