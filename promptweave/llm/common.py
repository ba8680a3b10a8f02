"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch.  With texts of up to a few MB a batch stays within a Python worker's memory.
ARROW_ROWS = 512

#: White space of every operator here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; one whose files make fewer partitions than there are cores is dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; in local mode only, one of our own where it is unset."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = context._jsc.sc().getCheckpointDir()
        found = set_before.get() if set_before.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="promptweave-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


#: Tables written and not yet dropped: the frame that reads one -> its folder.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_PATHS: dict[str, SparkSession] = {}


def _target(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and a lost executor loses nothing.

    A lazy result may read the files until `dropped` or `release` is called or the driver's JVM ends, which deletes
    them also where the session was stopped before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/promptweave-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, target = _target(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out], _PATHS[path] = path, spark
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete the files of saved tables that nothing will read again."""
    for table in tables:
        path = _WRITTEN.pop(table, None) if table is not None else None
        if path:
            _delete(path)


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.

    Spark deletes them once the driver's garbage is collected, which in a long chain of jobs may be hours later; until
    then each job's shuffles stand on the disk beside those of all jobs before it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Delete the files of all saved tables: for long-lived sessions, once the results are collected or written."""
    for path in list(_PATHS):
        _delete(path)
    _WRITTEN.clear()


def _delete(path: str) -> None:
    spark = _PATHS.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:  # else stopped: the JVM deletes them as it ends
        system, target = _target(spark, path)
        system.delete(target, True)
        system.cancelDeleteOnExit(target)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or a longer name that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus: the held-out folds of the learned operators."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def in_fold(doc_id: Column, modulus: int, fold: int) -> Column:
    """Whether the id falls in the fold; a null id falls in none."""
    return F.coalesce(crc_bucket(doc_id, modulus) == fold, F.lit(False))


def crc_bucket_py(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus
