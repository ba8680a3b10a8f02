"""Order within books: places and running sums.

Most books are small, and one window by book is the best plan for them.  Where a book has more than BOOK_ROWS entries (to
number its rows alone, SORTED_ROWS) its rows are laid out in ranges of (book, sort key) instead, over all tasks: a range is scanned by itself, and what it starts
from is carried over from the sums of the ranges before it, of which there are only as many as there are tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptweave.tables import written

#: Entries of a book up to which one task pairs, copies and joins them, and up to which one task sorts them: windows that
#: look at a whole book hold it, a sort spills.
BOOK_ROWS, SORTED_ROWS = 1 << 15, 1 << 20
#: Code points of a book's contents up to which its rows are sorted with them.
BOOK_TEXT = 1 << 24
_RANGE_BITS = 33  # of monotonically_increasing_id: the bits of the place within a partition


def by_ranges(entries: DataFrame, most: int | None = None) -> bool:
    """Whether a book is too large for one task (of more than BOOK_ROWS entries, or `most`); counts those of each book."""
    return (entries.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > (BOOK_ROWS if most is None else most)


def in_ranges(rows: DataFrame, keys: list[Column], what: str) -> DataFrame:
    """rows, written in ranges by book and keys, with _range and _at, which grows along the order."""
    names = {f"_key{i}": k for i, k in enumerate(keys)}
    laid = rows.withColumns(names).repartitionByRange("book_id", *names).sortWithinPartitions("book_id", *names)
    laid = laid.withColumn("_at", F.monotonically_increasing_id()).drop(*names)
    return written(laid, what).withColumn("_range", F.shiftright("_at", _RANGE_BITS))


def running(rows: DataFrame, amounts: dict[str, Column], within: list[str] | None = None) -> DataFrame:
    """rows in ranges with the running sum of each amount over the book (or other leading columns of the order), the
    row's own included."""
    group = within or ["book_id"]
    scan = Window.partitionBy(*group, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_range").agg(*[F.sum(v).alias(f"_{k}_sum") for k, v in amounts.items()])
    carried = sums.select(*group, "_range", *[F.coalesce(F.sum(f"_{k}_sum").over(earlier), F.lit(0)).alias(f"_{k}_before") for k in amounts])
    rows = rows.withColumns({k: F.sum(v).over(scan) for k, v in amounts.items()}).join(carried, [*group, "_range"])
    return rows.withColumns({k: F.col(k) + F.col(f"_{k}_before") for k in amounts}).drop(*[f"_{k}_before" for k in amounts])


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows in ranges, or some of them, with their 0-based place in the book; without _range and _at."""
    return running(rows, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) - 1).drop("_range", "_at")


def ranked(entries: DataFrame, keys: list[Column], name: str = "rn", ranges: bool | None = None) -> DataFrame:
    """entries with their 0-based place in the book under the keys; ranges None: as `by_ranges` finds for a sort."""
    if by_ranges(entries, SORTED_ROWS) if ranges is None else ranges:
        return numbered(in_ranges(entries, keys, "ranked"), name)
    return entries.withColumn(name, F.row_number().over(Window.partitionBy("book_id").orderBy(*keys)).cast("bigint") - 1)


def by_text(entries: DataFrame) -> bool:
    """Whether a book's contents are too large to be sorted in one task."""
    return (entries.groupBy("book_id").agg(F.sum(F.length("content").cast("bigint")).alias("n")).agg(F.max("n")).first()[0] or 0) > BOOK_TEXT


def placed(entries: DataFrame, keys: list[Column], name: str = "rn", ranges: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """`ranked` for rows of long contents, and a table to drop once the rows are written.

    The order puts a book's merged entries side by side, in one task and one file.  So places are found from the keys
    alone, and joined to the rows by a number of theirs, by which these are scattered.
    """
    rows = written(entries.withColumn("_no", F.monotonically_increasing_id()).repartition("_no"), "unplaced")
    names = {f"_by{i}": k for i, k in enumerate(keys)}
    places = ranked(rows.select("book_id", "_no", *[k.alias(n) for n, k in names.items()]), [F.col(n) for n in names], name, ranges)
    return rows.join(written(places.select("_no", name), "places"), "_no").drop("_no"), rows
