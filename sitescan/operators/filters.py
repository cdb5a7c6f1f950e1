"""Row filters and projections on site tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.operators.ordering import with_ordinal

SITE_COLUMNS = ("chr_n", "pos_ini", "pos_end")


def column_name(df: DataFrame, col: int | str) -> str:
    """Name of a column given by name or by ordinal; resolved when the plan is built."""
    if isinstance(col, str):
        if col not in df.columns:
            raise ValueError(f"no column {col!r} in {df.columns}")
        return col
    if not 0 <= col < len(df.columns):
        raise ValueError(f"no column {col} in a table of {len(df.columns)}")
    return df.columns[col]


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def rule_filter(
    df: DataFrame, rules: Sequence[tuple[int | str, Any]] | None, default_pass: bool = True
) -> DataFrame:
    """Rows by ``(column, value)`` rules: any match excludes a row, or includes it when
    ``default_pass`` is false. A null cell matches no rule, and values are compared without a
    cast: a text value never matches a numeric column."""
    if not rules:
        return df if default_pass else df.where(F.lit(False))
    tests = []
    for col, value in rules:
        name = column_name(df, col)
        kind = df.schema[name].dataType.simpleString()
        textual = kind == "string"
        if isinstance(value, str) != textual:
            tests.append(F.lit(False))
        else:
            tests.append(F.coalesce(_quoted(name) == F.lit(value), F.lit(False)))
    matched = reduce(lambda a, b: a | b, tests)
    return df.where(~matched if default_pass else matched)


def project_sites(
    df: DataFrame, cols: Sequence[int | str] = (0, 1, 2), keep: Sequence[str] = ()
) -> DataFrame:
    """Coordinate columns (by name or ordinal) renamed to ``chr_n, pos_ini, pos_end``; rows with a
    blank chromosome go, rows with a missing one stay. ``keep`` names further columns to carry."""
    if len(cols) != 3:
        raise ValueError("three coordinate columns are needed: chromosome, start, end")
    chosen = [_quoted(column_name(df, c)).alias(n) for c, n in zip(cols, SITE_COLUMNS)]
    out = df.select(*chosen, *[_quoted(c) for c in keep])
    return out.where((F.col("chr_n") != "") | F.col("chr_n").isNull())


def site_key_columns(df: DataFrame) -> tuple[str, str, str]:
    """Coordinate columns by name where present, else by ordinal 0, 1, 2."""
    return tuple(n if n in df.columns else column_name(df, i) for i, n in enumerate(SITE_COLUMNS))


def split_by_sequence(df: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows whose ``chr_n`` has a sequence, be it an empty one, and the others."""
    known = contigs.select("chr_n").distinct()
    return df.join(known, "chr_n", "left_semi"), df.join(known, "chr_n", "left_anti")


def skipped_count(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row ``n_skipped``: rows whose chromosome has no sequence."""
    return split_by_sequence(df, contigs)[1].agg(F.count(F.lit(1)).alias("n_skipped"))


def sample_peaks(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Random subset of ``n`` rows; ``n <= 0`` keeps all.

    The random order is a hash of the row's values and the seed, so a re-run task or another partitioning draws
    the same rows. Rows are selected, not sorted: counts by the first digits of the hash tell below which hash
    the ``n`` smallest lie, and only the rows below it are ranked. Rows that are equal in every column have equal
    hashes and any of them may be drawn.
    """
    if n <= 0:
        return df
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(_quoted(c).cast("string"), F.lit("")) for c in df.columns]))
    drawn = df.select(*[_quoted(c) for c in df.columns], draw.alias("_draw"))
    limit = _hash_limit(drawn, n)
    if limit is None:
        return df
    ranked = with_ordinal(drawn.where(F.col("_draw") < limit), "_draw", "_rank")
    return ranked.where(F.col("_rank") < n).select(*[_quoted(c) for c in df.columns])


def _hash_limit(drawn: DataFrame, n: int, digits: int = 3, slack: float = 0.25) -> str | None:
    """A hash below which there are at least ``n`` rows and few more; None if there are not more than ``n``.

    Each round counts the rows by three more digits of the hash, inside the group where the n-th row lies: at most
    4,096 counts come back. Rounds end when that group is a small part of ``n`` (or of a task's share), or when
    the hash has no more digits.
    """
    prefix, before = "", 0
    while True:
        own = drawn.where(F.col("_draw").startswith(prefix)) if prefix else drawn
        head = F.substring("_draw", 1, len(prefix) + digits).alias("_head")
        counts = sorted((r["_head"], r["n"]) for r in own.groupBy(head).agg(F.count(F.lit(1)).alias("n")).collect())
        if not prefix and sum(c for _, c in counts) <= n:
            return None
        for head_, count in counts:
            if before + count >= n:
                break
            before += count
        prefix = head_
        if count <= max(slack * n, 100_000) or len(prefix) + digits > 32:
            # "g" follows all digits of a hash.
            return prefix + "g"


