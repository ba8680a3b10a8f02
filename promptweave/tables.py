"""Tables between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, one of our own where it is unset."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        already = context._jsc.sc().getCheckpointDir()
        found = already.get() if already.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="promptweave-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark knows."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


#: The frame that reads a written table -> its folder.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, what: str) -> DataFrame:
    """df written once and read again: what follows does not run it anew, and a lost executor loses none of it.  The
    files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/promptweave-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, target = hadoop(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def dropped(table: DataFrame) -> None:
    """Delete the files of a written table that nothing will read again."""
    path = _WRITTEN.pop(table, None)
    if path:
        system, target = hadoop(table.sparkSession, path)
        system.delete(target, True)
        system.cancelDeleteOnExit(target)
