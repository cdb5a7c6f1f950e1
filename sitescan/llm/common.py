"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitescan.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: fixed row numbers, no second evaluation."""
    return cut_lineage(df)


def text_of(column: str = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; a missing value counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))) % modulus


def digest(text: Column) -> Column:
    """Join key of a text: results that depend on the text alone are joined back by it."""
    return F.md5(text)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


#: Bytes of an Arrow batch in sessions that leave it at Spark's default (64 MB, held by the JVM and by Python).
BATCH_BYTES = 8 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose function travels with the code of this package, so executors need no copy of it.

    Workers are reused by later tasks, so a task gives back what it held when it ends. Batches are kept small
    unless the session names a size.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    spark = df.sparkSession
    if spark.conf.get(_BYTES_SETTING, None) is None:
        spark.conf.set(_BYTES_SETTING, BATCH_BYTES)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_texts(
    df: DataFrame, key: list[Column], text: Column, kernel: Callable[[], Callable[[list], dict]], schema: str,
) -> DataFrame:
    """Rows of ``key`` columns followed by what ``kernel`` makes of the texts, batch by batch.

    ``kernel()`` runs once per task and returns a function from a list of texts (``str`` or ``bytes``, as the
    type of ``text`` is) to a dict of columns of the same length. ``schema`` names and types those.
    """
    source = df.select(*key, text.alias("_text"))
    keys = [f for f in source.schema.fields if f.name != "_text"]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    tail = kernel_types(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or kernel()
            # Slices bound what one call holds, however long the texts are.
            for part in slices(batch):
                at = part.schema.get_field_index("_text")
                made = work(part.column(at).to_pylist())
                arrays = [part.column(i) for i in range(part.num_columns) if i != at]
                names = [n for n in part.schema.names if n != "_text"]
                arrays += [x if isinstance(x := made[name], pa.Array) else pa.array(x, type=kind) for name, kind in tail]
                yield pa.RecordBatch.from_arrays(arrays, names=names + [name for name, _ in tail])

    return map_batches(source, run, f"{head}, {schema}" if head else schema)


def map_column(
    df: DataFrame, column: str, kernel: Callable[[], Callable[[pa.Array], dict]], schema: str,
    keep: list[str] | None = None, most: int = 1 << 20,
) -> DataFrame:
    """The ``keep`` columns of ``df`` (all by default) followed by what ``kernel`` makes of ``column``.

    The column goes to Python once, and comes back only if it is kept. ``kernel()`` runs once per task and
    returns a function from an Arrow array of about ``most`` bytes, or one longer value, to a dict of columns
    of the same length. Names of ``schema`` that clash with kept columns get a trailing underscore.
    """
    kept = df.columns if keep is None else list(keep)
    # Numbered names: a column may be called like anything, inside.
    sent = [*kept, *([] if column in kept else [column])]
    source = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(sent)])
    at, count, tail = sent.index(column), len(kept), kernel_types(df.sparkSession, schema)
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:count]]
    own = [f"_{count + i}" for i in range(len(tail))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or kernel()
            for part in slices(batch, most, at):
                made = work(part.column(at))
                arrays = part.columns[:count]
                arrays += [x if isinstance(x := made[name], pa.Array) else pa.array(x, type=kind) for name, kind in tail]
                yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names[:count] + own)

    fields = StructType.fromDDL(schema).fields
    typed = [f"`{o}` {f.dataType.simpleString()}" for o, f in zip(own, fields)]
    made = map_batches(source, run, ", ".join(head + typed))
    names, base = list(kept), df.select(*[F.col(f"`{c}`") for c in kept])
    for name, _ in tail:
        names.append(free_name(base, name))
    return made.select(*[F.col(a).alias(b) for a, b in zip(made.columns, names)])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(value of the first column, the other columns) of each run of equal values, across batches."""
    now, held = None, []
    for batch in batches:
        key, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if held and key[low] != now:
                yield now, [np.concatenate(c) for c in zip(*held)]
                held = []
            now = key[low]
            held.append([c[low:high] for c in rest])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


def slices(batch: pa.RecordBatch, most: int = 4 << 20, at: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``most`` bytes of text each, whole rows always; ``at`` is the text's column."""
    at = batch.schema.get_field_index("_text") if at is None else at
    lengths = np.asarray(pc.binary_length(batch.column(at)).fill_null(0))
    ends, start = np.cumsum(lengths, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def kernel_types(spark: SparkSession, schema: str) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]
