"""Tag pairs and headings of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .folds import fold, let, places
from .text import has, strip

TAG = rf"</?{P.NAME}+>"
# Open tags as one string of entries, sign name sign place: adding and cutting is then a copy of bytes.
_ENTRY, _AT = "\x01", "\x02"


def tag_tokens(content: Column) -> Column:
    """array<struct<tag, closes, at, end>> of all tags, in text order, places in code points."""

    def token(x: Column) -> Column:
        closes = F.startswith(x["m"], F.lit("</"))
        name = F.substring(x["m"], F.when(closes, 3).otherwise(2), F.length(x["m"]) - F.when(closes, 3).otherwise(2))
        return F.struct(name.alias("tag"), closes.alias("closes"), x["s"].alias("at"), x["e"].alias("end"))

    return F.transform(places(content, TAG), token)


def push(opened: Column, t: Column) -> Column:
    return F.concat(opened, F.lit(_ENTRY), t["tag"], F.lit(_AT), t["at"].cast("string"))


def pop(opened: Column, t: Column) -> Column:
    """struct<at, left, over> of the nearest open tag of t's name: its place, the others, and those opened after it.
    Null without one."""
    key = F.concat(F.lit(_ENTRY), t["tag"], F.lit(_AT))

    def cut(after: Column) -> Column:
        at = F.substring_index(after, _ENTRY, 1)
        over = F.substring(after, F.length(at) + 1, F.length(after))
        before = F.substring(opened, F.lit(1), F.length(opened) - F.length(after) - F.length(key))
        return F.struct(at.cast("int").alias("at"), F.concat(before, over).alias("left"), over.alias("over"))

    return F.when(F.contains(opened, key), let(F.call_function("substring_index", opened, key, F.lit(-1)), cut))


def still_open(opened: Column) -> Column:
    """array<struct<tag, at>> of open tags, the first opened first."""
    entries = F.filter(F.split(opened, _ENTRY, -1), lambda x: x != "")
    return F.transform(entries, lambda x: F.struct(F.substring_index(x, _AT, 1).alias("tag"), F.substring_index(x, _AT, -1).cast("int").alias("at")))


def tag_spans(content: Column) -> Column:
    """array<struct<tag, open_start, close_end>> of tag pairs, in the order of their closing tags.

    A closing tag takes the nearest open one of its name; open tags of other names stay open.
    """
    kind = "struct<tag:string,open_start:int,close_end:int>"

    def step(opened: Column, t: Column) -> tuple[Column, Column]:
        both = let(
            F.struct(F.when(t["closes"], pop(opened, t)).alias("p")),
            lambda x: F.struct(
                F.when(~t["closes"], push(opened, t)).when(x["p"].isNotNull(), x["p"]["left"]).otherwise(opened).alias("opened"),
                F.when(x["p"].isNotNull(), F.array(F.struct(t["tag"].alias("tag"), x["p"]["at"].alias("open_start"), t["end"].alias("close_end")))).otherwise(F.array().cast(f"array<{kind}>")).alias("out"),
            ),
        )
        return both["opened"], both["out"]

    return fold(tag_tokens(content), F.lit(""), step, kind)["out"]


def outermost(spans: Column) -> Column:
    """Name of the longest pair, the first one on a tie; null without pairs."""
    numbered = F.transform(spans, lambda x, i: F.struct((x["close_end"] - x["open_start"]).alias("size"), (-i).alias("nth"), x["tag"].alias("tag")))
    return F.array_max(numbered)["tag"]


def close_lines(lines: Column, spans: Column) -> Column:
    """Numbers of the lines that are one closing tag of a name that has a pair."""
    shape = rf"\A{P.WS}*</({P.NAME}+)>{P.WS}*\z"
    names = F.transform(spans, lambda x: x["tag"])
    numbered = F.transform(lines, lambda x, i: F.when(has(x, shape) & F.array_contains(names, F.regexp_extract(x, shape, 1)), i))
    return F.array_compact(numbered)


def heading_segments(lines: Column) -> Column:
    """array<struct<level, heading, start_line, end_line>>: a segment starts at each heading of level one or two, and
    at the first line."""
    shape = "(?d)" + P.HEADING

    def starts_of(ls: Column) -> Column:
        headed = F.array_compact(F.transform(ls, lambda x, i: F.when(has(x, shape), i)))
        return F.when(F.size(ls) > 0, F.array_distinct(F.concat(F.array(F.lit(0)), headed))).otherwise(F.array().cast("array<int>"))

    def segments(ls: Column, starts: Column) -> Column:
        def segment(s: Column, k: Column) -> Column:
            line = F.element_at(ls, s + 1)
            isin = has(line, shape)
            return F.struct(
                F.when(isin, F.length(F.regexp_extract(line, shape, 1))).alias("level"),
                F.when(isin, strip(F.regexp_extract(line, shape, 2))).otherwise(F.lit("")).alias("heading"),
                s.alias("start_line"),
                (F.coalesce(F.get(starts, k + 1), F.size(ls)) - 1).alias("end_line"),
            )

        return F.transform(starts, segment)

    # Lines and starts are computed once a text, not once a segment.
    return let(lines, lambda ls: let(starts_of(ls), lambda starts: segments(ls, starts)))
