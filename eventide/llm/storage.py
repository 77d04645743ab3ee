"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: shuffle files go at its end, and Python gets rows in batches of moderate size.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session, as in tests, may leave it unset and gets a temporary one that goes at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="eventide-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so losing an executor loses none of them.

    Columns can be pruned and it is compressed. The shuffle files behind it go as
    soon as it is written, and so do the staged tables ``spent``, which nothing
    reads any more. The table itself goes when the program ends.
    """
    out = stage_parts(df)
    release(*spent)
    return out


def stage_parts(*parts: DataFrame) -> DataFrame:
    """One staged table of the rows of all parts, which are written one after the other; the shuffle files of a part go before the next is begun."""
    df, spark = parts[0], parts[0].sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE}
    for k, v in _WHILE.items():
        spark.conf.set(k, v)
    try:
        for part in parts:
            part.write.mode("append").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        path = table.__dict__.pop("_staged_at", None)
        if path is not None:
            _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped: whoever owns the folder clears it
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
