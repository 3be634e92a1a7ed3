"""Tables that an operator writes on its way, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set = set()


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder in spark.checkpoint.dir, which driver and executors share; it goes when the driver's JVM ends.

    Where the setting is missing, a session on one machine gets a folder of its own; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir is not set: stored tables need a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", top)
    folder = f"{top.rstrip('/')}/waymark-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        system, path = _hadoop(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FOLDERS.add(folder)
    return folder


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: a cut in the lineage that outlives lost executors.

    The files stay for the session, so any frame derived from the result can be read at any time."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._waymark_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Ends stored tables that nothing reads any more."""
    for t in tables:
        system, path = _hadoop(t.sparkSession, t._waymark_path)
        system.delete(path, True)
