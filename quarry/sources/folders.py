"""Folders for what jobs write and read back."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a session on this machine alone (master ``local``) gets a temporary one; any other is refused,
    since each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir: name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` once as Parquet (with ``options`` of the writer) in the shared folder and read it back.

    What follows depends on files that outlive any executor, not on the lineage of ``df``.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def children(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and paths of what lies in a folder of any store that Spark reads; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName(): f.getPath().toString() for f in system.listStatus(folder)} if system.exists(folder) else {}


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders, if they are there."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*kept: DataFrame) -> None:
    """Free the space of tables that ``keep`` has written and no later step reads: their folders are deleted, without a job."""
    for path in {unquote(f.rsplit("/", 1)[0]) for df in kept for f in df.inputFiles()}:
        remove(kept[0].sparkSession, path)
