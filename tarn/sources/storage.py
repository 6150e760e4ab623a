"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and driver and executors are one process, as in tests.

    On a cluster without the setting there is no folder that all machines see, so that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tarn-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _at(df: DataFrame, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def materialize(df: DataFrame, name: str = "table", files: int | None = None, rows: int | None = None) -> DataFrame:
    """Writes ``df`` once and reads it back: a cut lineage that survives lost executors, and sizes for the planner.

    ``files``: as many at most, for tables that don't grow with the input; ``rows``: as many at most a file. The table goes when the session's JVM ends.
    Zstandard writes without the direct buffers that Snappy's writers leave to the next garbage collection.
    """
    at = _at(df, name)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").option("maxRecordsPerFile", rows or 0).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote and nothing will read again, as in loops."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
