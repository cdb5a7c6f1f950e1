"""Session helpers: recommended settings and the shared folder for cut lineage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "sitescan", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the recommended settings; keyword ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and intermediate tables.

    The session names it in ``spark.checkpoint.dir`` or has set a checkpoint folder. Where neither is so, the
    folder is ``sitescan`` in the session's warehouse (``spark.sql.warehouse.dir``), which is shared as well.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sitescan")
        current = context.getCheckpointDir()
    return named or current


#: Open scratch folders, the innermost last, of each thread and session.
_OPEN = threading.local()


def _stack(spark: SparkSession) -> list[str]:
    if not hasattr(_OPEN, "folders"):
        _OPEN.folders = {}
    return _OPEN.folders.setdefault(spark.sparkContext.applicationId, [])


@contextmanager
def scratch(spark: SparkSession, name: str = "job") -> Iterator[str]:
    """One folder for all that a job stores; it goes when the block ends, with every table in it.

    What is to outlive the job must be written elsewhere first. Without such a block the stages lie in the
    shared folder until whoever runs the session clears it.
    """
    path = scratch_path(spark, name)
    _stack(spark).append(path)
    try:
        yield path
    finally:
        _stack(spark).remove(path)
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of :func:`scratch_path`, through the file system that it lies in."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """New, unused path in the job's folder, or else in the shared folder."""
    open_ = _stack(spark)
    above = open_[-1] if open_ else shared_dir(spark).rstrip("/")
    return f"{above}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read back.

    Used where a result is read several times or must not change between two reads. It survives lost
    executors, and unlike a checkpoint it is pruned by column and has a known size.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
