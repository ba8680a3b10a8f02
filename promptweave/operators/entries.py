"""Entries as rows: columns and their defaults, filters, the six-key sort, renumbering, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.functions import patterns as P
from promptweave.functions import text as T

from .ordered import ranked

#: Columns that the operators read, with type and the value of a missing field.
CORE = {
    "book_id": ("bigint", "0"),
    "seq": ("bigint", None),
    "uid": ("bigint", None),
    "comment": ("string", "''"),
    "content": ("string", "''"),
    "ord": ("bigint", "100"),
    "position": ("int", "0"),
    "depth": ("int", "null"),
    "constant": ("boolean", "false"),
    "disable": ("boolean", "false"),
    "key": ("array<string>", "array()"),
    "role": ("int", "null"),
    "probability": ("int", "100"),
    "use_probability": ("boolean", "false"),
    "sticky": ("int", "0"),
    "cooldown": ("int", "0"),
    "delay": ("int", "0"),
    "display_index": ("bigint", "null"),
}


def complete(entries: DataFrame) -> DataFrame:
    """entries with every column of CORE: those there are cast, nulls of comment, content, ord, position, constant,
    disable and key get the default, those not there are added.  Further columns stay.  seq, the place in the book, is
    asked for; uid defaults to it."""
    have = set(entries.columns)
    out = []
    for name, (kind, default) in CORE.items():
        if name == "seq" and name not in have:
            raise ValueError("entries need the column seq, their place in the book")
        col = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if name == "uid":
            col = F.coalesce(col, F.col("seq"))
        elif default not in (None, "null"):
            col = F.coalesce(col, F.expr(default).cast(kind))
        out.append(col.alias(name))
    return entries.select(*out, *[c for c in entries.columns if c not in CORE])


def default_fields() -> dict[str, object]:
    """Every field of an entry with its default, in file order."""
    # Fixed values.
    return {
        "uid": None, "key": [], "keysecondary": [], "comment": "", "content": "", "constant": False, "disable": False,
        "selective": True, "selectiveLogic": 0, "order": 100, "position": 0, "depth": 4, "role": None, "probability": 100,
        "useProbability": True, "sticky": 0, "cooldown": 0, "delay": 0, "scanDepth": None, "caseSensitive": None,
        "matchWholeWords": None, "useGroupScoring": None, "matchPersonaDescription": False, "matchCharacterDescription": False,
        "matchCharacterPersonality": False, "matchCharacterDepthPrompt": False, "matchScenario": False, "matchCreatorNotes": False,
        "excludeRecursion": False, "preventRecursion": False, "delayUntilRecursion": 0, "ignoreBudget": False, "group": "",
        "groupOverride": False, "groupWeight": 100, "outletName": "", "automationId": "", "vectorized": False, "addMemo": False,
        "triggers": [], "characterFilter": {"names": [], "tags": [], "isExclude": False}, "displayIndex": None,
    }


def is_outlet(position: Column) -> Column:
    return position.eqNullSafe(F.lit(7))


def always_keyed(key: Column) -> Column:
    return F.coalesce(key == F.array(F.lit(P.ALWAYS_KEY)), F.lit(False))


def shown_static(content: Column, comment: Column, key: Column) -> Column:
    """Static for listings: copies, wrappers and always-keyed entries are not."""
    return T.is_static(content) & ~(T.is_copy(comment) | T.is_supplement(comment) | always_keyed(key))


def sort_keys(static: Column, copy: Column, supplement: Column) -> list[Column]:
    """Category, wrapper side, stability, position, depth, original order, place: stable prefix first."""
    at_depth = (F.col("position") == 4) & F.col("depth").isNotNull()
    return [
        F.when(~static | copy | supplement, 1).otherwise(0),
        F.when(~supplement, 1).when(F.contains("comment", F.lit(P.SUPPLEMENT_START)), 0).otherwise(2),
        F.when(~at_depth, 1).when(F.col("depth") >= 10, 0).otherwise(2),
        F.col("position"),
        F.when(at_depth, -F.col("depth")).otherwise(0),
        F.col("ord"),
        F.col("seq"),
    ]


def plain_keys() -> list[Column]:
    """The six keys of a book that carries no copies or wrappers of its own."""
    return sort_keys(T.is_static(F.col("content")), F.lit(False), F.lit(False))


def plain_sort(entries: DataFrame, name: str = "rn", ranges: bool | None = None) -> DataFrame:
    """Place in the six-key sort of a book that carries no copies or wrappers of its own."""
    return ranked(entries, plain_keys(), name, ranges)


def renumbered(entries: DataFrame, place: str = "rn") -> DataFrame:
    """ord, uid, display_index and seq from the place."""
    at = F.col(place)
    return entries.withColumns({"ord": at, "uid": at, "display_index": at, "seq": at}).drop(place)


# Filters


def by_static(entries: DataFrame, static: bool) -> DataFrame:
    flag = shown_static(F.col("content"), F.col("comment"), F.col("key"))
    return entries.filter(flag if static else ~flag)


def by_label(entries: DataFrame, label: str) -> DataFrame:
    return entries.filter(T.entry_label(F.col("content"), F.col("comment")) == label)


def by_order(entries: DataFrame, low: int, high: int) -> DataFrame:
    return entries.filter(F.coalesce("ord", F.lit(-1)).between(low, high))


def by_uid(entries: DataFrame, uids: list[int]) -> DataFrame:
    return entries.filter(F.col("uid").isin(uids))


def by_search(entries: DataFrame, text: str, any_case: bool) -> DataFrame:
    """Comment or content contains text."""
    fold = F.lower if any_case else (lambda c: c)
    needle = F.lit(text.lower() if any_case else text)
    return entries.filter(F.contains(fold(F.col("comment")), needle) | F.contains(fold(F.col("content")), needle))


# Summaries


def label_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("book_id", T.entry_label(F.col("content"), F.col("comment")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def continuity(col: str) -> Column:
    """Aggregate: the values are 0 .. n-1, each once."""
    return (F.min(col) == 0) & (F.max(col) == F.count(F.lit(1)) - 1) & (F.countDistinct(col) == F.count(F.lit(1)))


def summary(entries: DataFrame) -> DataFrame:
    """A row per book: count of each label, ranges of order and uid, whether they are continuous."""
    label = T.entry_label(F.col("content"), F.col("comment"))
    kinds = ["static", "dynamic", "boundary", "supplement", "merged"]
    numbered = entries.select("book_id", F.coalesce("ord", F.lit(0)).alias("ord"), F.coalesce("uid", F.lit(0)).alias("uid"), label.alias("label"))
    return numbered.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("label") == k).alias(f"n_{k}") for k in kinds],
        F.min("ord").alias("min_ord"),
        F.max("ord").alias("max_ord"),
        continuity("ord").alias("ord_continuous"),
        F.min("uid").alias("min_uid"),
        F.max("uid").alias("max_uid"),
        continuity("uid").alias("uid_continuous"),
    )


def frontier(entries: DataFrame) -> DataFrame:
    """A row per book: the last static order, the first dynamic one, and whether the static part comes first."""
    label = T.entry_label(F.col("content"), F.col("comment"))
    moving = label.isin("boundary", "supplement", "dynamic")
    rows = entries.select("book_id", F.coalesce("ord", F.lit(0)).alias("ord"), moving.alias("moving"))
    return bordered(rows, []).drop("n")


def bordered(rows: DataFrame, more: list[Column]) -> DataFrame:
    """rows (book_id, ord, moving) -> book_id, static_max, dynamic_min, n, static_first and further aggregates."""
    found = rows.groupBy("book_id").agg(
        *more,
        F.coalesce(F.max(F.when(~F.col("moving"), F.col("ord"))), F.lit(-1)).alias("static_max"),
        F.coalesce(F.min(F.when(F.col("moving"), F.col("ord"))), F.count(F.lit(1))).alias("dynamic_min"),
        F.count(F.lit(1)).alias("n"),
    )
    bad = (F.col("static_max") >= 0) & (F.col("dynamic_min") < F.col("n")) & (F.col("static_max") > F.col("dynamic_min"))
    return found.withColumn("static_first", ~bad)
