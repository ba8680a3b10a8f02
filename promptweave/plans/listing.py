"""Listings and queries over entries, as rows and as rendered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.functions import text as T
from promptweave.operators import entries as E


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def listing(entries: DataFrame, static: bool | None = None) -> DataFrame:
    """Entries in sorted order: book_id, rn, ord, position, depth, static, constant, uid, comment, content, key."""
    rows = E.complete(entries)
    if static is not None:
        rows = E.by_static(rows, static)
    rows = rows.withColumn("static", E.shown_static(F.col("content"), F.col("comment"), F.col("key")))
    rows = E.ranked(rows, E.sort_keys(F.col("static"), F.lit(False), F.lit(False)))
    return rows.select("book_id", "rn", "ord", "position", "depth", "static", "constant", "uid", "comment", "content", "key")


def listing_csv(listed: DataFrame) -> DataFrame:
    line = F.concat_ws(",", _shown("ord"), _shown("position"), _shown("depth"), T.mark(F.col("static")), T.mark(F.col("constant")), _shown("uid"), F.col("comment"))
    return listed.select("book_id", "rn", line.alias("line"))


def listing_table(listed: DataFrame) -> DataFrame:
    line = F.format_string("%5s  %3s  %5s  %6s  %6s  %4s  %s", _shown("ord"), _shown("position"), _shown("depth"), T.mark(F.col("static")), T.mark(F.col("constant")), _shown("uid"), F.col("comment"))
    return listed.select("book_id", "rn", line.alias("line"))


def listing_summary(listed: DataFrame) -> DataFrame:
    return listed.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("static").alias("n_static"), F.count_if(~F.col("static")).alias("n_dynamic"))


def full_listing(entries: DataFrame, static: bool | None = None, uid: int | None = None, search: str | None = None, most: int | None = 500) -> DataFrame:
    """Listing with a content preview; uid goes before search.  most None: whole contents."""
    rows = E.complete(entries)
    if uid is not None:
        rows = E.by_uid(rows, [uid])
    elif search is not None:
        rows = E.by_search(rows, search, any_case=True)
    rows = listing(rows, static)
    content, size = F.col("content"), F.length("content")
    if most is None:
        label, shown = F.lit("Content:"), content
    else:
        label = F.when(size <= most, F.concat(F.lit("Content ("), size.cast("string"), F.lit(" chars):"))).otherwise(F.concat(F.lit(f"Content preview ({most}/"), size.cast("string"), F.lit(" chars):")))
        shown = T.preview(content, most)
    keys = F.when(F.size("key") > 0, F.array_join("key", ", ")).otherwise("--")
    return rows.select("book_id", "rn", "uid", "ord", "position", "depth", "static", "constant", "comment", keys.alias("keys"), label.alias("label"), shown.alias("preview"))


def query(entries: DataFrame, label: str | None = None, order_range: tuple[int, int] | None = None, search: str | None = None) -> DataFrame:
    """Filtered entries by order: book_id, rn, ord, position, depth, label, constant, disable, uid, comment."""
    rows = E.complete(entries)
    if label:
        rows = E.by_label(rows, label)
    if order_range:
        rows = E.by_order(rows, *order_range)
    if search:
        rows = E.by_search(rows, search, any_case=False)
    rows = E.ranked(rows, [F.col("ord"), F.col("seq")])
    return rows.select("book_id", "rn", "ord", "position", "depth", T.entry_label(F.col("content"), F.col("comment")).alias("label"), "constant", "disable", "uid", "comment")


def query_csv(found: DataFrame) -> DataFrame:
    line = F.concat_ws(",", _shown("ord"), _shown("position"), _shown("depth"), F.col("label"), T.mark(F.col("constant")), T.mark(F.col("disable")), _shown("uid"), F.col("comment"))
    return found.select("book_id", "rn", line.alias("line"))


def query_table(found: DataFrame) -> DataFrame:
    line = F.format_string("%4s  %5s  %3s  %5s  %10s  %6s  %4s  %4s  %s", _shown("rn"), _shown("ord"), _shown("position"), _shown("depth"), F.col("label"), T.mark(F.col("constant")), T.mark(F.col("disable")), _shown("uid"), F.col("comment"))
    return found.select("book_id", "rn", line.alias("line"))
