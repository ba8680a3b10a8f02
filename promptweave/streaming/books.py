"""The four steps for books whose files arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptweave.functions import patterns as P
from promptweave.plans.pipeline import pipeline
from promptweave.sources.books import parse_books


def arriving_books(spark: SparkSession, path: str) -> DataFrame:
    """Stream of (book_id, value), one row per new file."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path)
    return files.select(F.xxhash64(F.input_file_name()).alias("book_id"), "value")


def rerun(books: DataFrame, out: str, checkpoint: str, wrapper_name: str = P.WRAPPER_NAME) -> StreamingQuery:
    """Runs the steps on each batch of books and writes their entries to out, a folder per batch.

    A batch that is run again after a failure overwrites its own folder, so its books are there once.
    """

    def step(batch: DataFrame, number: int) -> None:
        entries = pipeline(parse_books(batch), wrapper_name).drop("raw", "map_key")
        entries.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return books.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
