"""Table, BED and FASTA writers; each writes a directory of parts in the order asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, sep: str = ";", order_by: Sequence[str | Column] | None = None,
    drop: Sequence[str] = (),
) -> None:
    """``;`` table with a header in every part; missing cells are empty. Replaces what is there.

    ``order_by`` sorts over the parts (a range shuffle); ``drop`` names columns that only served the order.
    """
    if order_by:
        df = df.orderBy(*order_by)
    df.drop(*drop).write.mode("overwrite").csv(
        path, sep=sep, header=True, nullValue="", emptyValue="", escape='"'
    )


def write_bed(df: DataFrame, path: str) -> None:
    """Headerless tab table of the columns as they stand."""
    df.write.mode("overwrite").csv(path, sep="\t", header=False, nullValue="", emptyValue="", quote="")


def write_fasta(records: DataFrame, path: str, order_by: str | None = "ordinal") -> None:
    """``>id`` and ``seq`` lines per record; parts are ranges of ``order_by``, so their order is kept."""
    if order_by and order_by in records.columns:
        records = records.orderBy(order_by)
    records.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), F.col("seq")).alias("value")).write.mode(
        "overwrite"
    ).text(path)
