"""Scalar building blocks as Spark ``Column`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitescan.defaults import MISSING_TOKENS

# IUPAC nucleotide codes and their complements.
IUPAC = "ACGTURYKMBVDHSWN"
IUPAC_COMPLEMENT = "TGCAAYRMKVBHDSWN"

_NUMBER = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contig(chr_n: Column | str) -> Column:
    """``chr1`` -> ``1``; only the ``chr`` prefix goes, so ``chrM`` -> ``M``."""
    return F.regexp_replace(_col(chr_n), "^chr", "")


def signed_fold_change(log2_fc: Column | str) -> Column:
    """log2 fold change -> signed fold change; 0 stays 0 and NaN stays NaN."""
    x = _col(log2_fc)
    return F.signum(x) * F.pow(F.lit(2.0), F.abs(x))


def is_missing(cell: Column | str) -> Column:
    """True for null and for the cells the CSV readers take for a missing number."""
    c = _col(cell)
    return c.isNull() | F.trim(c).isin(MISSING_TOKENS)


def parse_number(cell: Column | str) -> Column:
    """Text -> double: a missing cell is NaN, text that is no number is null."""
    c = _col(cell)
    t = F.trim(c)
    return (
        F.when(is_missing(c), F.lit(float("nan")))
        .when(t.rlike(_NUMBER), t.try_cast("double"))
    )


def split_ids(cell: Column | str) -> Column:
    """``a| b||c`` -> ``[a, b, c]``: split on the bar, trimmed, without empties.

    A missing cell counts as the identifier ``nan``, as it does after a pandas read.
    """
    parts = F.split(F.coalesce(_col(cell), F.lit("nan")), r"\|")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def revcomp(seq: Column | str) -> Column:
    """Reverse complement, upper-cased, with the IUPAC ambiguity codes."""
    return F.translate(F.reverse(F.upper(_col(seq))), IUPAC, IUPAC_COMPLEMENT)


def reverse_complement(seq: str) -> str:
    """Driver-side twin of :func:`revcomp`, for the short words a caller passes in."""
    return seq.upper().translate(str.maketrans(IUPAC, IUPAC_COMPLEMENT))[::-1]


def gene_origin(strand: Column | str, start: Column | str, end: Column | str) -> Column:
    """First transcribed base: the start on the plus strand, else the end."""
    return F.when(_col(strand) == "+", _col(start)).otherwise(_col(end))


def direction_label(fold_change: Column | str, mode: str = "inherited") -> Column:
    """Direction of a gene in the co-occupancy report.

    ``inherited`` keeps the inverted labels of the original report: negative is ``upreg``, anything else,
    missing included, is ``downreg``. ``signed`` labels by sign and gives null for zero and missing.
    """
    fc = _col(fold_change)
    if mode == "inherited":
        return F.when(fc < 0, "upreg").otherwise("downreg")
    if mode == "signed":
        return F.when((fc > 0) & ~F.isnan(fc), "upreg").when(fc < 0, "downreg")
    raise ValueError(f"unknown label mode {mode!r}: use 'inherited' or 'signed'")


def resize_bounds(pos_ini: Column | str, pos_end: Column | str, length: int) -> tuple[Column, Column]:
    """Bounds with ``pos_end - pos_ini == length``, moved alternately on both sides.

    Closed form of the one-base-at-a-time walk: growing gives the odd base to the left side,
    shrinking takes it from the right side.
    """
    ini, end = _col(pos_ini).cast("bigint"), _col(pos_end).cast("bigint")
    missing = F.lit(length).cast("bigint") - (end - ini)
    half_up = F.shiftright(F.abs(missing) + 1, 1)
    half_down = F.shiftright(F.abs(missing), 1)
    new_ini = F.when(missing > 0, ini - half_up).otherwise(ini + half_down)
    new_end = F.when(missing > 0, end + half_down).otherwise(end - half_up)
    return new_ini, new_end


def expand_bounds(pos_ini: Column | str, pos_end: Column | str, dist: int) -> tuple[Column, Column]:
    """Bounds moved outwards by ``dist``; a ``dist`` of zero or less leaves them alone."""
    d = max(int(dist), 0)
    return _col(pos_ini) - F.lit(d).cast("bigint"), _col(pos_end) + F.lit(d).cast("bigint")


def fasta_id(ordinal: Column | str, chr_n: Column | str, pos_ini: Column | str, pos_end: Column | str) -> Column:
    """``{ordinal}_{chr}_{ini}_{end}``."""
    return F.concat_ws("_", *[_col(c).cast("string") for c in (ordinal, chr_n, pos_ini, pos_end)])
