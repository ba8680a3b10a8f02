"""Prompt assembly: the sections of a book's prompt, with its chat, as ordered rows and as one text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.functions import patterns as P
from promptweave.functions import text as T
from promptweave.operators import entries as E
from promptweave.operators.ordered import in_ranges
from promptweave.tables import written

#: Section of each placement; entries elsewhere are left out.
RANKS = {0: 2, 1: 7, 5: 8, 6: 9, 4: 10, 2: 12, 3: 13}
CHAT = 11
# The titles of the sections.
_TITLES = {
    1: "[1/12] System Prompt", 2: "[2/12] World Info (before) pos=0", 3: "[3/12] Persona Description", 4: "[4/12] Character Description",
    5: "[5/12] Character Personality", 6: "[6/12] Scenario", 7: "[7/12] World Info (after) pos=1", 8: "[8/12] Chat Examples pos=5 [top]",
    10: "[9/12] Chat History (with pos=4 atDepth)", 12: "[10/12] Author's Note pos=2/3",
}


def placeholder(name: str) -> str:
    return f"[{name} Placeholder]"


def sections(
    entries: DataFrame,
    chat: DataFrame | None = None,
    system: str | None = None,
    persona: str | None = None,
    scenario: str | None = None,
    card: DataFrame | None = None,
    comments: bool = False,
) -> DataFrame:
    """book_id, section, part, text of each book's prompt, in the order of (section, part).

    chat (book_id, turn, role, text): without it one placeholder message stands for it; with it a book without rows has
    no messages, and then its entries by depth are left out.  card (book_id, description, personality, scenario).
    Disabled and constant flags, keys and probabilities play no part.
    """
    rows = E.plain_sort(E.complete(entries))
    books = rows.select("book_id").distinct()
    if chat is None:
        chat = books.select("book_id", F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit(placeholder("Chat History")).alias("text"))
    messages = chat.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_messages"))
    section = F.coalesce(*[F.when(F.col("position") == p, r) for p, r in RANKS.items()])
    placed = rows.withColumn("section", section).filter("section is not null").join(messages, "book_id", "left")
    placed = placed.filter((F.col("position") != 4) | ((F.col("depth") >= 0) & (F.coalesce("n_messages", F.lit(0)) > 0)))
    by_depth = F.when(F.col("position") == 4, -F.col("depth")).otherwise(0).cast("bigint")
    part = F.struct(by_depth.alias("group"), F.lit(1).alias("kind"), F.col("rn").alias("rn"), F.lit(1).alias("line"))
    out = [placed.select("book_id", "section", part.alias("part"), F.col("content").alias("text"))]

    def single(rank: int, text: Column, kind: int = 1, source: DataFrame = books) -> None:
        at = F.struct(F.lit(0).cast("bigint").alias("group"), F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("rn"), F.lit(0).alias("line"))
        out.append(source.select("book_id", F.lit(rank).alias("section"), at.alias("part"), text.alias("text")))

    single(1, T.strip(F.lit(system if system is not None else placeholder("System Prompt"))))
    single(3, T.strip(F.lit(persona if persona is not None else placeholder("Persona Description"))))
    with_card = books.join(card, "book_id", "left") if card is not None else books.withColumns({c: F.lit(None).cast("string") for c in ("description", "personality", "scenario")})
    single(4, T.strip(F.coalesce("description", F.lit(placeholder("Character Description")))), source=with_card)
    single(5, T.strip(F.coalesce("personality", F.lit(placeholder("Character Personality")))), source=with_card)
    single(6, T.strip(F.lit(scenario) if scenario else F.coalesce("scenario", F.lit(placeholder("Scenario")))), source=with_card)
    who = F.coalesce(*[F.when(F.col("role") == k, v) for k, v in P.ROLE_LABELS.items()], F.col("role"))
    at_turn = F.struct(F.lit(0).cast("bigint").alias("group"), F.lit(1).alias("kind"), F.col("turn").alias("rn"), F.lit(1).alias("line"))
    out.append(chat.select("book_id", F.lit(CHAT).alias("section"), at_turn.alias("part"), F.concat(who, F.lit(": "), "text").alias("text")))
    if comments:
        out += _comments(placed, chat, books, by_depth, single)
    found = reduce(DataFrame.unionByName, out)
    return found.select("book_id", "section", F.col("part.group").alias("part_group"), F.col("part.kind").alias("part_kind"), F.col("part.rn").alias("part_rn"), F.col("part.line").alias("part_line"), "text")


def _comments(placed: DataFrame, chat: DataFrame, books: DataFrame, by_depth: Column, single) -> list[DataFrame]:
    for rank, title in _TITLES.items():
        text = F.lit(("" if rank == 1 else "\n") + f"<!-- ============ {title} ============ -->")
        held = {2: 2, 7: 7, 8: 8}.get(rank)
        if rank == 12:
            source = placed.filter(F.col("section").isin(12, 13)).select("book_id").distinct()
        else:
            source = placed.filter(F.col("section") == held).select("book_id").distinct() if held else books
        single(rank, text, 0 if rank != 10 else -1, source)
    single(9, F.lit("\n<!-- Chat Examples pos=6 [bottom] -->"), 0, placed.filter("section = 9").select("book_id").distinct())

    def at(kind: int, line: int, rn: Column) -> Column:
        return F.struct(by_depth.alias("group"), F.lit(kind).alias("kind"), rn.alias("rn"), F.lit(line).alias("line")).alias("part")

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    entry = F.concat(F.lit("<!-- Entry uid="), shown("uid"), F.lit(": order="), shown("ord"), F.lit(' "'), "comment", F.lit('" static='), T.mark(T.is_static(F.col("content"))), F.lit(" pos="), shown("position"), F.lit(" depth="), shown("depth"), F.lit(" -->"))
    injected = F.concat(F.lit("<!--   injected: Entry uid="), shown("uid"), F.lit(" order="), shown("ord"), F.lit(' comment="'), "comment", F.lit('" pos=4 depth='), shown("depth"), F.lit(" -->"))
    turn = F.struct(F.lit(0).cast("bigint").alias("group"), F.lit(1).alias("kind"), F.col("turn").alias("rn"), F.lit(0).alias("line")).alias("part")
    by_turn = F.concat(F.lit("\n<!-- Chat Message "), (F.col("turn") + 1).cast("string"), F.lit(": -->"))
    n = placed.groupBy("book_id").agg(F.count_if(F.col("position") == 4).alias("n"))
    totals = books.join(n, "book_id", "left").select(
        "book_id", F.lit(14).alias("section"), F.struct(F.lit(0).cast("bigint").alias("group"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("rn"), F.lit(0).alias("line")).alias("part"),
        F.concat(F.lit("\n<!-- ============================================ -->\n<!-- 总计: 12 段, "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" 个 WI 条目注入 -->")).alias("text"),
    )
    return [
        placed.select("book_id", "section", at(1, 0, F.col("rn")), entry.alias("text")),
        placed.filter("position = 4").select("book_id", "section", at(0, 0, F.col("rn")), injected.alias("text")),
        chat.select("book_id", F.lit(CHAT).alias("section"), turn, by_turn.alias("text")),
        totals,
    ]


def _joined(place: str, text: str) -> Column:
    """Aggregate: the texts in order, joined by line ends; null without any."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.col(text).alias("text"))))
    return F.when(F.count(text) > 0, F.array_join(F.transform(listed, lambda x: x["text"]), "\n"))


def prompt_text(parts: DataFrame) -> DataFrame:
    """book_id, text: the sections of a book joined by line ends.

    Parts are laid out in ranges over all tasks and each range is joined by itself, so a book's own task holds a text a
    range and the whole, not every part.  The whole is one value, of 2 GB at most.
    """
    keys = ["section", "part_group", "part_kind", "part_rn", "part_line"]
    laid = in_ranges(written(parts, "prompt-parts"), [F.col(k) for k in keys], "prompt-sorted")
    pieces = laid.groupBy("book_id", "_range").agg(_joined("_at", "text").alias("piece"))
    return pieces.groupBy("book_id").agg(F.coalesce(_joined("_range", "piece"), F.lit("")).alias("text"))
