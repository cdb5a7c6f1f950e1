"""Row ordinals in a given order, without putting the rows through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitescan.session import cut_lineage

def with_file_order(df: DataFrame, name: str = "row_ord") -> DataFrame:
    """Tags the rows of a file scan with ``struct(file, block, row)``, which sorts in input order.

    Must sit directly on the scan. Rows of one split keep their order and lie next to each other in one
    partition, so the row number only has to be compared within a split.
    """
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(name),
    )


def with_ordinal(df: DataFrame, order_col: str, name: str = "ordinal") -> DataFrame:
    """Adds the dense 0-based ordinal of each row in the order of ``order_col`` (unique, not null).

    The rows are range-partitioned by the order column and numbered inside their partition; the rows before
    each partition come from one count per partition, the only thing that is put in one place. Range bounds
    are sampled anew whenever a plan runs (and a file order depends on how the scan was split), so the
    numbered rows are stored before they are used twice. The column of :func:`with_file_order` is dropped.
    """
    numbered = cut_lineage(
        df.repartitionByRange(order_col)
        .sortWithinPartitions(order_col)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    columns = [c for c in df.columns if c != order_col or df.schema[c].dataType.typeName() != "struct"]
    # One row per shuffle partition: small whatever the table's size.
    return numbered.join(F.broadcast(bases), part == F.col("_part")).select(
        *[F.col(f"`{c}`") for c in columns],
        (F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """First row per key in the order of ``order_col``, which must be unique within a key.

    ``min_by`` of the whole row combines map-side; a window would send every row of a hot key to one task.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), order_col).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[
        F.col(f"_row.`{c}`").alias(c) if c in others else F.col(f"`{c}`") for c in df.columns
    ])
