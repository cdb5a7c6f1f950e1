"""Motif tables: counts -> log-odds, best scores and cutoffs, and the panel handed to the scan."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.defaults import BACKGROUND, PSEUDOCOUNT, SCORE_MULT

BASES = "ACGT"
#: Weights (8 bytes each) up to which all motifs go to every task at once.
PANEL_CELLS = 200_000


def motif_log_odds(counts: DataFrame, pseudocount: float = PSEUDOCOUNT, background: float = BACKGROUND) -> DataFrame:
    """(motif, pos, base, count) -> the same with ``log_odds``; a base without a row counts 0.

    ``log2(((count + pseudo) / (total + 4 * pseudo)) / background)``. A ``motif_ord`` column is kept; without
    one the motifs are taken in the order of their names.
    """
    order = [F.min("motif_ord").alias("motif_ord")] if "motif_ord" in counts.columns else []
    kept = ["motif", "motif_ord"] if order else ["motif"]
    wide = counts.groupBy("motif", "pos").agg(
        *order, *[F.sum(F.when(F.col("base") == b, F.col("count")).otherwise(0.0)).alias(b) for b in BASES]
    )
    total = sum(F.col(b) for b in BASES) + F.lit(4 * pseudocount)
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("count")) for b in BASES]))
    return wide.select(*kept, "pos", total.alias("_total"), cells.alias("_cell")).select(
        *kept, "pos", "_cell.base", F.col("_cell.count").alias("count"),
        # No count and no pseudocount: the base cannot occur. Spark's logarithm of zero would be null.
        F.when((F.col("_cell.count") + pseudocount == 0) & (F.col("_total") > 0), F.lit(float("-inf"))).otherwise(
            F.log2((F.col("_cell.count") + pseudocount) / F.nullif("_total", F.lit(0.0)) / F.lit(background))
        ).alias("log_odds"),
    )


def motif_cutoffs(motifs: DataFrame, score_mult: float = SCORE_MULT) -> DataFrame:
    """(motif, max_score, cutoff): the best score is the sum of the column maxima, taken in position order.

    The scan applies these very values, so a reported cutoff is the one a window had to reach.
    """
    best = motifs.groupBy("motif", "pos").agg(F.max("log_odds").alias("best"))
    maxima = F.array_sort(F.collect_list(F.struct("pos", "best")))  # as long as the motif
    return best.groupBy("motif").agg(F.aggregate(maxima, F.lit(0.0), lambda s, x: s + x["best"]).alias("max_score")).select(
        "motif", "max_score", (F.col("max_score") * F.lit(float(score_mult))).alias("cutoff")
    )


class Motif(NamedTuple):
    """One motif as the scan needs it."""

    name: str
    order: int
    weights: np.ndarray  # positions x ACGT
    cutoff: float


def motif_rows(
    motifs: DataFrame, score_mult: float = SCORE_MULT, cutoffs: dict[str, float] | float | None = None
) -> DataFrame:
    """One row a motif: ``motif, motif_ord, cells (pos, base, log_odds), cutoff``.

    ``cutoffs`` is one number for all motifs or names them; without it a cutoff is ``score_mult`` of the best score.
    """
    if "motif_ord" not in motifs.columns:
        motifs = motifs.withColumn("motif_ord", F.lit(0))
    rows = motifs.groupBy("motif").agg(
        F.min("motif_ord").alias("motif_ord"), F.collect_list(F.struct("pos", "base", "log_odds")).alias("cells")
    )
    if cutoffs is None:
        return rows.join(motif_cutoffs(motifs, score_mult).select("motif", "cutoff"), "motif")
    if not isinstance(cutoffs, dict):
        return rows.withColumn("cutoff", F.lit(float(cutoffs)))
    given = F.create_map(*[F.lit(x) for kv in cutoffs.items() for x in (kv[0], float(kv[1]))]) if cutoffs else None
    return rows.withColumn("cutoff", given[F.col("motif")] if cutoffs else F.lit(None).cast("double"))


def make_motif(name: str, order: int, cells: list, cutoff: float | None) -> Motif:
    length = max(c["pos"] for c in cells) + 1
    weights = np.full((length, 4), np.nan)
    for c in cells:
        weights[c["pos"], BASES.index(c["base"])] = np.nan if c["log_odds"] is None else c["log_odds"]
    if np.isnan(weights).any():
        raise ValueError(f"motif {name!r} lacks a weight for some position and base")
    if cutoff is None:
        raise KeyError(name)
    return Motif(name, order, weights, float(cutoff))


def longest_motif(motifs: DataFrame | None) -> int:
    """Positions of the longest motif; 0 without motifs."""
    last = motifs.agg(F.max("pos")).first()[0] if motifs is not None else None
    return 0 if last is None else last + 1
