"""Site tables: bounds, and the hits of a scan put back on their sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.defaults import HIT_BIN_BITS
from sitescan.functions import expand_bounds, resize_bounds
from sitescan.operators.intervals import hits_in_slices
from sitescan.operators.sequences import SLICE_COLUMNS
from sitescan.operators.stats import reported_start


def resize_sites(df: DataFrame, length: int) -> DataFrame:
    """Sites resized to ``pos_end - pos_ini == length``; a length of zero or less keeps them."""
    if length <= 0:
        return df
    ini, end = resize_bounds("pos_ini", "pos_end", length)
    return df.withColumns({"pos_ini": ini, "pos_end": end})


def expand_sites(df: DataFrame, dist: int) -> DataFrame:
    """Sites with ``search_ini, search_end``, moved outwards by ``dist``."""
    ini, end = expand_bounds("pos_ini", "pos_end", dist)
    return df.withColumns({"search_ini": ini, "search_end": end})


def site_hits(
    located: DataFrame, hits: DataFrame, one_based: bool = False, bits: int = HIT_BIN_BITS
) -> DataFrame:
    """One row per located site and hit inside it: the site's columns, then
    ``hit_pos_ini, hit_pos_end, hit_seq, hit_source, hit_score, hit_strand, hit_ord, hit_tf_name``."""
    keep = [c for c in located.columns if c not in SLICE_COLUMNS]
    first = reported_start(one_based=one_based)
    return hits_in_slices(located, hits, "inner", bits).select(
        *[F.col(f"`{c}`") for c in keep],
        first.alias("hit_pos_ini"),
        (first + F.col("hit_len") - 1).alias("hit_pos_end"),
        "hit_seq", "hit_source", F.col("hit_score_pssm").alias("hit_score"), "hit_strand", "hit_ord",
        "hit_tf_name",
    )
