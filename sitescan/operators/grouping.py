"""Grouping by whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_row(df: DataFrame, columns: list[str], *aggregates: Column) -> DataFrame:
    """One output row per distinct ``columns``, followed by the aggregates.

    The columns are grouped as one struct. Grouped side by side, a table already partitioned by one of them
    (the chromosome, after a join) would count as grouped too: Spark would save the shuffle, leave a hot
    chromosome in one task, and keep AQE from splitting the join below.
    """
    key = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_key")
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    packed = df.select(key, *others)
    grouped = packed.groupBy("_key").agg(*aggregates) if aggregates else packed.select("_key").distinct()
    added = [F.col(f"`{c}`") for c in grouped.columns if c != "_key"]
    return grouped.select(*[F.col(f"_key.`{c}`").alias(c) for c in columns], *added)
