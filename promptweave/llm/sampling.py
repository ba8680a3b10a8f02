"""Bounded samples of labelled rows, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_per_label(rows: DataFrame, label: str, key: Column, per_label: int) -> DataFrame:
    """About per_label rows of every label, chosen by a hash of key: the same rows on every run.

    One counting aggregation and a join with its result, a row for each label; no sort.  A label with fewer rows is
    taken whole.
    """
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.pmod(F.xxhash64(key.cast("string")), F.lit(1_000_003)) / 1_000_003.0
    met = rows.join(counts, F.col(label) == F.col("_label")).filter(share < F.lit(per_label) / F.col("_n"))
    return met.select(*rows.columns)
