"""BED, delimited tables, genes tables and expression tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitescan.functions.scalars import is_missing
from sitescan.operators.expression import (
    expression_rows, first_fold_change, first_translated, translate_names,
)
from sitescan.operators.filters import column_name
from sitescan.operators.ordering import with_file_order, with_ordinal

GENES_SCHEMA = "gene_id string, chr_n string, pos0 bigint, biotype string, fold_change double"


def read_bed(
    spark: SparkSession, path: str, n_cols: int = 3, sep: str = "\t", row_order: bool = False
) -> DataFrame:
    """Headerless BED: ``chr_n, pos_ini, pos_end`` and text columns ``col_3 ...`` up to ``n_cols``.

    Starts are taken as they stand (not shifted to 1-based). Comment lines and ``track``/``browser`` lines are
    dropped; any other row whose start or end is no whole number ends the job with the row in the message.
    ``row_order`` adds the input order as ``row_ord``.
    """
    if n_cols < 3:
        raise ValueError("a BED table has at least three columns")
    names = ["chr_n", "pos_ini", "pos_end", *(f"col_{i}" for i in range(3, n_cols))]
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.read.schema(schema).csv(path, sep=sep, header=False, comment="#", quote="")
    if row_order:
        df = with_file_order(df)
    whole = r"^\s*[+-]?[0-9]+\s*$"
    bad = F.raise_error(F.concat(F.lit("BED row without whole start and end: "), F.concat_ws(
        sep, *[F.coalesce(F.col(n), F.lit("")) for n in names[:3]]
    )))
    number = lambda c: F.when(F.rlike(F.coalesce(F.col(c), F.lit("")), F.lit(whole)), F.trim(c).cast("bigint")).otherwise(bad)
    return df.where(~F.rlike("chr_n", F.lit(r"^(track|browser)(\s|$)")) | F.col("pos_ini").isNotNull()).select(
        "chr_n", *[number(c).alias(c) for c in ("pos_ini", "pos_end")], *[c for c in df.columns if c not in names[:3]]
    )


def read_table(
    spark: SparkSession, path: str, sep: str = ";", schema: str | T.StructType | None = None,
    row_order: bool = False,
) -> DataFrame:
    """Delimited table with a header; a cell that says "missing" is null, whatever its column's type.

    Give a schema to save the extra pass that infers the types.
    """
    reader = spark.read.option("sep", sep).option("header", True).option("escape", '"')
    text = reader.csv(path)  # names only: all columns as text
    if row_order:
        text = with_file_order(text)
    names = [c for c in text.columns if c != "row_ord" or not row_order]
    kinds = _as_struct(spark, schema) if schema is not None else _inferred(text, names)
    if len(kinds.fields) != len(names):
        raise ValueError(f"{len(names)} columns in the file, {len(kinds.fields)} in the schema")
    cells = [
        _cell(F.col(f"`{n}`"), f.dataType, schema is not None).alias(f.name) for n, f in zip(names, kinds.fields)
    ]
    return text.select(*cells, *([F.col("row_ord")] if row_order else []))


def _as_struct(spark: SparkSession, schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _cell(cell: Column, kind: T.DataType, declared: bool) -> Column:
    """A column declared as a number keeps the difference between "no number" and no cell."""
    value = _present(cell).try_cast(kind)
    if declared and isinstance(kind, T.DoubleType):
        value = F.when(F.lower(F.trim(cell)).isin("nan", "-nan"), F.lit(float("nan"))).otherwise(value)
    return value


def _present(cell: Column) -> Column:
    return F.when(~is_missing(cell), cell)


def _inferred(text: DataFrame, names: list[str]) -> T.StructType:
    """Whole numbers, numbers or text, by every cell that is not missing."""
    cells = [_present(F.trim(F.col(f"`{n}`"))) for n in names]
    tests = []
    for i, c in enumerate(cells):
        tests += [
            F.count(c).alias(f"n{i}"), F.count(c.try_cast("bigint")).alias(f"w{i}"), F.count(c.try_cast("double")).alias(f"d{i}")
        ]
    found = text.agg(*tests).first()
    kind = lambda i: (
        T.StringType() if not found[f"n{i}"] or found[f"d{i}"] < found[f"n{i}"]
        else T.LongType() if found[f"w{i}"] == found[f"n{i}"] else T.DoubleType()
    )
    return T.StructType([T.StructField(n, kind(i)) for i, n in enumerate(names)])


def read_genes(spark: SparkSession, path: str, sep: str = ";", row_order: bool = False) -> DataFrame:
    """Genes table as the generate job writes it, keyed by ``chr_n`` in the joins."""
    return read_table(spark, path, sep, GENES_SCHEMA, row_order)


def read_raw_expression(
    spark: SparkSession, path: str, id_col: int = 0, value_col: int = 3, name_col: int | None = None,
    sep: str = ";",
) -> DataFrame:
    """(row_ord, raw_id, raw_value[, gene_name]) as text, columns picked by ordinal."""
    df = spark.read.csv(path, sep=sep, header=True, escape='"')
    picked = {"raw_id": id_col, "raw_value": value_col}
    if name_col is not None:
        picked["gene_name"] = name_col
    columns = [F.col(f"`{column_name(df, c)}`").alias(n) for n, c in picked.items()]
    tagged = with_file_order(df.select(*columns, "_metadata"))
    return with_ordinal(tagged.drop("_metadata"), "row_ord", "_n").select(
        F.col("_n").alias("row_ord"), *picked
    )


def read_expression_rows(
    spark: SparkSession, path: str, id_col: int = 0, value_col: int = 3, name_col: int | None = None,
    annotation: DataFrame | None = None, sep: str = ";",
) -> DataFrame:
    """One row per identifier before the first one wins; input of ``expression_conflicts`` too."""
    rows = _expression_rows(spark, path, id_col, value_col, name_col, annotation, sep)
    return rows if annotation is None else translate_names(rows, annotation)


def _expression_rows(spark, path, id_col, value_col, name_col, annotation, sep, seen=None) -> DataFrame:
    if (name_col is None) != (annotation is None):
        raise ValueError("translating names needs both name_col and annotation")
    return expression_rows(read_raw_expression(spark, path, id_col, value_col, name_col, sep), seen)


def read_expression(
    spark: SparkSession, path: str, id_col: int = 0, value_col: int = 3, name_col: int | None = None,
    annotation: DataFrame | None = None, sep: str = ";", seen: Observation | None = None,
) -> DataFrame:
    """(gene_id, fold_change): log2 values turned into signed fold changes, first row per gene.

    ``seen`` as in ``expression_rows``: the counts of the load, taken while it runs.
    """
    rows = _expression_rows(spark, path, id_col, value_col, name_col, annotation, sep, seen)
    return first_fold_change(rows) if annotation is None else first_translated(rows, annotation)
