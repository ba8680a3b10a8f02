"""Embedded code blocks of a text: a fold over its lines, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .folds import fold, let
from .text import is_static, lines_of, net_braces, residue, strip

_BLOCK = "struct<type:string,s:int,e:int>"
_RANGE = "struct<s:int,e:int>"


def _last(text: Column, what: str) -> Column:
    """Code points before the last `what` in text, -1 without one."""
    at = F.locate(what[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at - len(what) + 1).otherwise(-1)


def _body(raw: Column) -> Column:
    """What stands between the first opening sign and the last closing one; to the end without one."""
    begin = F.length(F.regexp_extract(raw, rf"(?s)\A(.*?{P.CODE_OPEN})", 1))
    last = _last(raw, "%>")
    end = F.when(last >= 0, last).otherwise(F.length(raw))
    return F.substring(raw, begin + 1, F.greatest(end - begin, F.lit(0)))


def _one(kind: str, first: Column, last: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("type"), first.alias("s"), last.alias("e")))


def _folded(lines: Column, texts: bool) -> Column:
    """The fold over lines to array<struct<type, s, e>> of the first and last lines of blocks of code and, if asked, of
    text; state since: the first line of a block that is still open, else -1.

    A line that opens a block and closes it afterwards is a block of code; else the block runs to the next line with a
    closing sign, or to the end of the text.  Each line outside of code is a block of text.
    """

    def signs(line: Column) -> Column:
        after = F.substring(line, F.locate("<%", line) + 2, F.length(line))
        opens = F.contains(line, F.lit("<%"))
        return F.struct(F.contains(line, F.lit("%>")).alias("closes"), opens.alias("opens"), (opens & F.contains(after, F.lit("%>"))).alias("whole"))

    def step(at: Column, line: Column) -> tuple[Column, Column]:
        inside = at["since"] >= 0
        closes, opens, whole = line["closes"], line["opens"], line["whole"]
        done = F.when(inside & closes, _one("ejs", at["since"], at["i"])).when(~inside & opens & whole, _one("ejs", at["i"], at["i"]))
        if texts:
            done = done.when(~inside & ~opens, _one("text", at["i"], at["i"]))
        goes_on = (inside & ~closes) | (~inside & opens & ~whole)
        since = F.when(goes_on, F.when(inside, at["since"]).otherwise(at["i"])).otherwise(F.lit(-1))
        return F.struct((at["i"] + 1).alias("i"), since.alias("since")), done.otherwise(F.array().cast(f"array<{_BLOCK}>"))

    return fold(F.transform(lines, signs), F.struct(F.lit(0).alias("i"), F.lit(-1).alias("since")), step, _BLOCK)


def _spans(lines: Column, texts: bool) -> Column:
    """array<struct<type, s, e>> of all blocks, the one that is open at the end included."""

    def ended(x: Column) -> Column:
        rest = _one("ejs", x["state"]["since"], x["state"]["i"] - 1)
        return F.when(x["state"]["since"] >= 0, F.concat(x["out"], rest)).otherwise(x["out"])

    return let(_folded(lines, texts), ended)


def _sign_lines(content: Column) -> Column:
    """array<string>: content cut after each line that holds a sign of code.

    Folding these finds the same code as folding lines: a line without signs neither opens nor closes, and what stands
    before an opening sign is no part of the block's body.
    """
    shape = rf"(?s)\G.*?(?:<%|%>)[^{P.SEPS}]*(?:\r\n|[{P.SEPS}]|\z)"

    def cut(found: Column) -> Column:
        end = F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x))
        return F.concat(found, F.array(F.substring(content, end + 1, F.length(content))))

    return let(F.regexp_extract_all(content, F.lit(shape), F.lit(0)), cut)


def ends_open(content: Column) -> Column:
    """Whether a block is open after the last line."""
    return F.when(F.contains(content, F.lit("<%")), _folded(_sign_lines(content), texts=False)["state"]["since"] >= 0).otherwise(False)


def _raw(lines: Column, b: Column) -> Column:
    return F.array_join(F.slice(lines, b["s"] + 1, b["e"] - b["s"] + 1), "")


def blocks_of(content: Column) -> Column:
    """array<struct<type, content, start_line, end_line, brace_delta>> of the blocks of code and text."""

    def block(lines: Column, b: Column) -> Column:
        code = b["type"] == "ejs"
        return let(
            F.when(code, _body(_raw(lines, b))).otherwise(_raw(lines, b)),
            lambda body: F.struct(
                b["type"].alias("type"),
                F.when(code, strip(body)).otherwise(body).alias("content"),
                b["s"].alias("start_line"),
                b["e"].alias("end_line"),
                F.when(code, net_braces(body)).otherwise(F.lit(0)).alias("brace_delta"),
            ),
        )

    return let(lines_of(content), lambda lines: F.transform(_spans(lines, texts=True), lambda b: block(lines, b)))


def code_balance(content: Column) -> Column:
    """Sum of the brace differences of all blocks, without making those of text: for texts of any number of lines."""

    def net(raw: Column) -> Column:
        return let(let(raw, _body), net_braces)

    balance = let(
        _sign_lines(content),
        lambda lines: F.aggregate(F.transform(_spans(lines, texts=False), lambda b: net(_raw(lines, b))), F.lit(0), lambda a, x: a + x),
    )
    return F.when(F.contains(content, F.lit("<%")), balance).otherwise(0)


def bad_braces(blocks: Column) -> Column:
    """A block with twenty or more braces left open or closed too often: its entry is quarantined, not fatal."""
    return F.exists(blocks, lambda b: F.abs(b["brace_delta"]) >= 20)


def compound_ranges(blocks: Column, n_lines: Column) -> Column:
    """array<struct<s, e>> of lines under open braces; an unclosed one runs to the last line."""

    def step(at: Column, b: Column) -> tuple[Column, Column]:
        depth = at["depth"] + b["brace_delta"]
        since = F.when(at["since"].isNull() & (depth > 0), b["start_line"]).otherwise(at["since"])
        ends = (depth == 0) & since.isNotNull()
        one = F.array(F.struct(since.alias("s"), b["end_line"].alias("e")))
        return F.struct(depth.alias("depth"), F.when(~ends, since).alias("since")), F.when(ends, one).otherwise(F.array().cast(f"array<{_RANGE}>"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("since"))
    done = fold(F.filter(blocks, lambda b: b["type"] == "ejs"), start, step, _RANGE)

    def ended(x: Column) -> Column:
        rest = F.array(F.struct(x["state"]["since"].alias("s"), F.greatest(n_lines - 1, F.lit(0)).cast("int").alias("e")))
        return F.when(x["state"]["since"].isNotNull(), F.concat(x["out"], rest)).otherwise(x["out"])

    return let(done, ended)


def is_unclosed(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0), lambda a, b: a + b["brace_delta"]) != 0


def in_ranges(line: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (r["s"] <= line) & (line <= r["e"]))


def fully_covered(n_lines: Column, ranges: Column) -> Column:
    return (n_lines == 0) | F.forall(F.sequence(F.lit(0), F.greatest(n_lines - 1, F.lit(0)).cast("int")), lambda i: in_ranges(i, ranges))


def classified(content: Column, ranges: Column, n_lines: Column) -> tuple[Column, Column]:
    """(static, mixed).  Mixed: markers, and text left beside code and macros that no open brace covers throughout."""
    static = is_static(content)
    left = strip(residue(content)) != ""
    covered = (F.size(ranges) > 0) & fully_covered(n_lines, ranges)
    return static, ~static & left & ~covered
