"""Books as JSON files: reading to entries, writing back, chats, texts, artifact names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweave.operators.entries import CORE, default_fields

#: Columns whose field has another name in the file.
FIELDS = {"ord": "order", "use_probability": "useProbability", "display_index": "displayIndex"}
_TYPED = [c for c in CORE if c not in ("book_id", "seq")]


def field_of(column: str) -> str:
    return FIELDS.get(column, column)


def raw_books(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, value."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def parse_books(books: DataFrame) -> DataFrame:
    """books (book_id, value) -> entries: seq, map_key, the columns of CORE and raw (map<string, variant>).

    Entries stand in file order.  Both `{"entries": {...}}` and a list are read; a book without either has none.  A
    field that is missing becomes null here and gets its default where it is used; raw tells missing from null.
    """
    as_map = F.from_json("value", "entries map<string,string>")["entries"]
    as_list = F.from_json("value", "entries array<string>")["entries"]
    pairs = F.coalesce(
        F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))),
        F.transform(as_list, lambda v, i: F.struct(i.cast("string").alias("k"), v.alias("v"))),
    )
    rows = books.select("book_id", F.posexplode(pairs).alias("pos", "e"))
    rows = rows.select("book_id", F.col("pos").cast("bigint").alias("seq"), F.col("e.k").alias("map_key"), F.from_json("e.v", "map<string,variant>").alias("raw"))

    def typed(name: str) -> Column:
        kind = CORE[name][0]
        return F.expr(f"try_variant_get(raw['{field_of(name)}'], '$', '{kind}')").alias(name)

    return rows.select("book_id", "seq", "map_key", *[typed(c) for c in _TYPED], "raw")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all files under path; book_id is a hash of the file's name."""
    return parse_books(raw_books(spark, path).select(F.xxhash64("path").alias("book_id"), "value"))


def damaged(books: DataFrame) -> DataFrame:
    """books (value and others) with code: A1 for what is no JSON, A2 where entries are neither a map nor a list; those
    only."""
    books = books.withColumn("doc", F.expr("try_parse_json(value)"))
    kind = F.expr("schema_of_variant(variant_get(doc, '$.entries'))")
    code = F.when(F.col("doc").isNull(), "A1").when(~kind.rlike("^(OBJECT|ARRAY|VOID)") & kind.isNotNull(), "A2")
    return books.withColumn("code", code).drop("doc").filter("code is not null")


def damaged_books(spark: SparkSession, path: str) -> DataFrame:
    """path, code of files that are no JSON (A1) or whose entries are neither a map nor a list (A2)."""
    return damaged(raw_books(spark, path)).select("path", "code")


def entry_json(entries: DataFrame) -> Column:
    """One entry as JSON: its own fields in their order with the typed columns' values, missing ones after them."""
    parts = {field_of(c): c for c in _TYPED}
    have_raw = "raw" in entries.columns
    values = F.to_json(F.struct(*[F.col(c).alias(f) for f, c in parts.items()]), {"ignoreNullFields": "false"})
    if not have_raw:
        return values
    new = F.from_json(values, "map<string,variant>")
    own = F.coalesce(F.col("raw"), F.from_json(F.lit(default_json()), "map<string,variant>"))
    changed = F.transform_values(own, lambda k, v: F.when(F.map_contains_key(new, k), F.element_at(new, k)).otherwise(v))
    added = F.map_filter(new, lambda k, v: ~F.map_contains_key(own, k))
    return F.to_json(F.map_concat(changed, added))


def new_entry_json(entries: DataFrame) -> Column:
    """An entry as JSON with every field: those that its table has, the defaults of the others."""
    given = {field_of(c): F.col(c) for c in _TYPED if c in entries.columns}
    new = F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in given.items()])), "map<string,variant>")
    own = F.from_json(F.lit(default_json()), "map<string,variant>")
    return F.to_json(F.transform_values(own, lambda k, v: F.coalesce(F.element_at(new, k), v)))


def default_json() -> str:
    return json.dumps(default_fields(), ensure_ascii=False)


def book_json(entries: DataFrame) -> DataFrame:
    """A row per book: book_id, value, the file's text with entries keyed 0, 1, ... by seq."""
    rows = entries.select("book_id", "seq", entry_json(entries).alias("json"))
    listed = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", "json"))).alias("all"))
    inner = F.array_join(F.transform("all", lambda x, i: F.concat(F.lit('"'), i.cast("string"), F.lit('":'), x["json"])), ",")
    return listed.select("book_id", F.concat(F.lit('{"entries":{'), inner, F.lit("}}")).alias("value"))


def write_books(entries: DataFrame, path: str) -> None:
    """One text file per task with a book a line, in folders by book."""
    book_json(entries).write.partitionBy("book_id").mode("overwrite").text(path)


def reread(spark: SparkSession, path: str) -> DataFrame:
    """Entries of what write_books wrote; book_id as it was."""
    return parse_books(spark.read.text(path).select(F.col("book_id").cast("bigint"), "value"))


def artifact_name(stem: str, step: str) -> str:
    """Table or file name of a step's result."""
    if step not in ("analysis", "split", "reordered", "merged"):
        raise ValueError(f"no such step: {step}")
    return f"{stem}_{step}"


def chat_messages(chats: DataFrame) -> DataFrame:
    """chats (book_id, value) -> book_id, turn, role, text of the list `chat`, else `messages`."""
    kind = "array<struct<role:string,content:string>>"
    parsed = F.from_json("value", f"chat {kind}, messages {kind}")
    rows = chats.select("book_id", F.posexplode(F.coalesce(parsed["chat"], parsed["messages"])).alias("pos", "m"))
    return rows.select("book_id", F.col("pos").cast("bigint").alias("turn"), F.coalesce("m.role", F.lit("user")).alias("role"), F.coalesce("m.content", F.lit("")).alias("text"))


def character_card(cards: DataFrame) -> DataFrame:
    """cards (book_id, value) -> book_id, description, personality, scenario; null where missing."""
    card = F.from_json("value", "description string, personality string, scenario string")
    return cards.select("book_id", card["description"].alias("description"), card["personality"].alias("personality"), card["scenario"].alias("scenario"))


def chain_counts(artifacts: dict[str, DataFrame]) -> DataFrame:
    """Entries per book of each step's artifact: book_id, step, n."""
    found = None
    for step, df in artifacts.items():
        part = df.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(step))
        found = part if found is None else found.unionByName(part)
    return found.select("book_id", "step", "n")
