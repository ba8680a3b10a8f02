"""Validation: every rule yields rows (book_id, code, level, scope, uid, message)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptweave.functions import blocks as B
from promptweave.functions import patterns as P
from promptweave.functions import tags as G
from promptweave.functions import text as T
from promptweave.functions.folds import by_blocks, fold, let, running_sum
from promptweave.operators import entries as E
from promptweave.operators.crossings import crossings, matched
from promptweave.operators.ordered import in_ranges, running
from promptweave.sources.books import chain_counts
from promptweave.tables import written

from .prompt import sections


def finding(rows: DataFrame, code: str, level: str, scope: str, message: Column, uid: Column | None = None) -> DataFrame:
    return rows.select("book_id", F.lit(code).alias("code"), F.lit(level).alias("level"), F.lit(scope).alias("scope"), (uid if uid is not None else F.lit(None)).cast("bigint").alias("uid"), message.alias("message"))


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def all_of(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def totals(findings: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """A row per book: errors, warnings, passed.  books (book_id): those without findings have a row too."""
    found = findings.groupBy("book_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    if books is not None:
        found = books.select("book_id").distinct().join(found, "book_id", "left").fillna(0)
    return found.withColumn("passed", F.col("errors") == 0)


# Rules on one entry.  The codes and messages, here and below, are fixed values.


def file_rules(parsed: DataFrame) -> DataFrame:
    """A3, A4 on entries as read from files (map_key, raw)."""
    uid = F.expr("try_variant_get(raw['uid'], '$', 'string')")
    number = F.expr("try_variant_get(raw['uid'], '$', 'bigint')")
    other = parsed.filter(~uid.eqNullSafe(F.col("map_key")))
    bare = parsed.filter(~F.map_contains_key("raw", F.lit("content")))
    return all_of([
        finding(other, "A3", "error", "entry", _said("uid=", uid, " != entries key=", F.col("map_key")), number),
        finding(bare, "A4", "error", "entry", F.lit("content field missing"), number),
    ])


def _f8() -> tuple[Column, Column]:
    lines = T.lines_of(F.col("content"))
    shape = rf"\A<({P.NAME}+)>\z"
    first, last = (F.regexp_extract(T.strip(F.element_at(lines, n)), shape, 1) for n in (1, -1))
    # Lines are cut only where a tag stands at both ends.
    tagged = T.has(F.col("content"), rf"\A{P.WS}*<{P.NAME}+>") & T.has(F.col("content"), rf"<{P.NAME}+>{P.WS}*\z")
    bad = F.when(tagged, F.when(F.size(lines) >= 2, (first != "") & (first == last) & ~first.isin(P.NOT_TAGS)).otherwise(False)).otherwise(False)
    return bad, _said("possible self-closing tag <", first, "> at both start and end, should use <", first, ">...</", first, ">")


def row_rules() -> dict[str, tuple[Column, Column]]:
    """code -> (condition, message) of the rules that look at one entry."""
    content, position, depth = F.col("content"), F.col("position"), F.col("depth")
    elsewhere, static = ~position.eqNullSafe(F.lit(4)), T.is_static(content)
    empty = ~T.has(content, f"[^{P.WS[1:]}")
    return {
        "D1": (T.has(content, rf"\A{P.WS}*[<#]") & T.is_bare(content), F.lit("content only contains heading/tag, no body text")),
        "F1": (F.col("constant") & (F.size("key") > 0), F.lit("constant=true but key is not empty")),
        "F2": (F.col("use_probability") & (F.col("probability") < 100) & static, F.lit("static entry with probability < 100")),
        "F3": (elsewhere & ~static, _said("dynamic entry with position=", position, " (expected 4)")),
        "F4": ((depth >= 10) & elsewhere, _said("depth>=10 but position=", position, " (depth only meaningful at pos=4)")),
        "F5": (empty, F.lit("content is empty")),
        # Never found: the macro itself makes an entry dynamic.
        "F7": (F.contains(content, F.lit("{{time}}")) & static, F.lit("static entry contains {{time}} macro (time-varying)")),
        "F8": _f8(),
    }


def entry_findings(rows: DataFrame, codes: list[str]) -> DataFrame:
    """Findings of rules on single entries, in one pass over them."""
    rules = row_rules()
    said = [F.when(rules[c][0], F.struct(F.lit(c).alias("code"), rules[c][1].alias("message"))) for c in codes]
    found = rows.select("book_id", "uid", F.explode_outer(F.array_compact(F.array(*said))).alias("f")).filter("f is not null")
    return found.select("book_id", F.col("f.code").alias("code"), F.lit("warning").alias("level"), F.lit("entry").alias("scope"), "uid", F.col("f.message").alias("message"))


def f6(rows: DataFrame) -> DataFrame:
    """The same order twice in one position and depth."""
    group = Window.partitionBy("book_id", "position", "depth", "ord").orderBy("seq")
    again = rows.withColumn("_first", F.first("uid").over(group)).withColumn("_nth", F.row_number().over(group)).filter("_nth > 1")
    said = _said("order=", F.col("ord"), " duplicate with uid=", F.col("_first"), " in group (pos=", F.col("position"), ", depth=", F.col("depth"), ")")
    return finding(again, "F6", "warning", "entry", said, F.col("uid"))


def d2(rows: DataFrame) -> DataFrame:
    """Opening and closing headings, as whole contents, without their counterpart anywhere in the book."""
    text = T.strip(F.col("content"))
    shape = r"(?d)\A" + P.MD_BOUNDARY[1:]
    marked = rows.filter(T.has(F.col("content"), rf"\A{P.WS}*#") & T.has(text, shape)).select("book_id", "seq", "uid", T.strip(F.regexp_extract(text, shape, 2)).alias("base"), F.regexp_extract(text, shape, 3).isin(P.OPEN_WORDS).alias("opens"))
    opened = marked.filter("opens").groupBy("book_id", "base").agg(F.max_by("uid", "seq").alias("uid"))
    closed = marked.filter("not opens")
    return all_of([
        finding(opened.join(closed, ["book_id", "base"], "left_anti"), "D2", "warning", "cross-entry", _said("MD boundary #", F.col("base"), "开始 has no matching end"), F.col("uid")),
        finding(closed.join(opened, ["book_id", "base"], "left_anti"), "D2", "warning", "cross-entry", _said("MD boundary #", F.col("base"), "结束 has no matching start")),
    ])


# Rules on the assembled prompt (book_id, text)


def _line(text: Column, at: Column) -> Column:
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def _one(code: str, level: str, bad: Column, message: Column) -> Column:
    return F.array_compact(F.array(F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), message.alias("message")))))


def b1(text: Column, lines_before: Column | None = None) -> Column:
    """A block that is opened after the last closed one."""
    closed = F.aggregate(F.regexp_extract_all(text, F.lit(r"(?s)\G.*?<%.*?%>"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    at = F.locate("<%", F.substring(text, closed + 1, F.length(text)))
    return _one("B1", "error", F.contains(text, F.lit("<%")) & (at > 0), _said("EJS block not closed near line ", _line(text, closed + at - 1) + (0 if lines_before is None else lines_before)))


def _unbalanced(net: Column) -> Column:
    return _one("B2", "error", net != 0, _said("EJS brace unbalanced: net=", net))


def b2(text: Column) -> Column:
    return _unbalanced(B.code_balance(text))


def _tag_tokens(text: Column) -> Column:
    return F.filter(G.tag_tokens(text), lambda t: ~t["tag"].isin(P.NOT_TAGS))


def _lined_tokens(text: Column) -> Column:
    """Tag tokens (tag, closes, at), at being the line; the line ends between tags are counted once."""
    none = F.array().cast("array<struct<tag:string,closes:boolean,at:int>>")

    def lined(ts: Column) -> Column:
        between = F.transform(F.split(text, G.TAG, -1), lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
        lines = F.slice(running_sum(between), F.lit(1), F.size(ts))
        return F.filter(F.zip_with(ts, lines, lambda t, n: F.struct(t["tag"].alias("tag"), t["closes"].alias("closes"), (n + 1).alias("at"))), lambda t: ~t["tag"].isin(P.NOT_TAGS))

    return F.when(F.contains(text, F.lit("<")), let(G.tag_tokens(text), lined)).otherwise(none)


def _tag_findings(tokens: Column, line_of: Callable[[Column], Column]) -> Column:
    """C3 crossing, C4 unclosed, C5 unopened tags of tokens (tag, closes, at)."""
    kind = "struct<code:string,tag:string,other:string,at:int>"
    none = F.array().cast(f"array<{kind}>")

    def one(code: str, tag: Column, other: Column | None, at: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), tag.alias("tag"), (F.lit(None).cast("string") if other is None else other).alias("other"), at.alias("at"))

    def step(opened: Column, t: Column) -> tuple[Column, Column]:
        def taken(x: Column) -> Column:
            crossed = F.reverse(F.transform(G.still_open(x["p"]["over"]), lambda o: one("C3", o["tag"], t["tag"], o["at"])))
            after = F.when(~t["closes"], G.push(opened, t)).when(x["p"].isNotNull(), x["p"]["left"]).otherwise(opened)
            found = F.when(~t["closes"], none).when(x["p"].isNotNull(), crossed).otherwise(F.array(one("C5", t["tag"], None, t["at"])))
            return F.struct(after.alias("opened"), found.alias("out"))

        both = let(F.struct(F.when(t["closes"], G.pop(opened, t)).alias("p")), taken)
        return both["opened"], both["out"]

    def told(x: Column) -> Column:
        line = line_of(x["at"])
        said = (
            F.when(x["code"] == "C3", _said("XML tag crossing: <", x["tag"], "> not closed before </", x["other"], "> near line ", line))
            .when(x["code"] == "C4", _said("XML tag <", x["tag"], "> unclosed near line ", line))
            .otherwise(_said("XML tag </", x["tag"], "> has no open"))
        )
        return F.struct(x["code"].alias("code"), F.lit("error").alias("level"), said.alias("message"))

    done = fold(tokens, F.lit(""), step, kind)
    all_found = let(done, lambda x: F.concat(x["out"], F.transform(G.still_open(x["state"]), lambda o: one("C4", o["tag"], None, o["at"]))))
    return F.transform(all_found, told)


def tag_rules(text: Column) -> Column:
    """C3 crossing, C4 unclosed, C5 unopened tags."""
    return _tag_findings(_tag_tokens(text), lambda at: _line(text, at))


def _macro_counts(text: Column) -> tuple[Column, Column]:
    return F.regexp_count(text, F.lit(r"\{\{")), F.regexp_count(text, F.lit(r"\}\}"))


def _mismatched(opens: Column, closes: Column) -> Column:
    return _one("E1", "warning", opens != closes, _said("Macro brace mismatch: opens=", opens, ", closes=", closes))


def e1(text: Column) -> Column:
    return _mismatched(*_macro_counts(text))


def e2(text: Column) -> Column:
    shape = r"(?s)<%[-=](.*?)%>"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(shape), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(shape), F.lit(1)).alias("body"))
    nested = F.filter(pairs, lambda x: F.contains(x["body"], F.lit("{{")))
    return F.transform(nested, lambda x: F.struct(F.lit("E2").alias("code"), F.lit("warning").alias("level"), F.concat(F.lit("EJS output block contains nested macro: "), F.substring(x["all"], 1, 60)).alias("message")))


def text_findings(texts: DataFrame) -> DataFrame:
    """Findings on assembled prompts (book_id, text), in one pass over them."""
    text = F.col("text")
    return _assembled(texts.select("book_id", F.explode(F.concat(b1(text), b2(text), tag_rules(text), e1(text), e2(text))).alias("f")))


def _assembled(found: DataFrame) -> DataFrame:
    return found.select("book_id", F.col("f.code").alias("code"), F.col("f.level").alias("level"), F.lit("assembled").alias("scope"), F.lit(None).cast("bigint").alias("uid"), F.col("f.message").alias("message"))


# The same rules on the parts of prompts, so that no prompt has to stand in one row


def _after(text: Column, sign: str) -> Column:
    return F.substring(text, F.locate(sign, text) + len(sign), F.length(text))


def _moves(text: Column) -> dict[str, Column]:
    """How a part of a prompt leads on what is open where it begins: name0 and name1 tell whether a block is open after
    it, if none or one is before it.  code: <% to %>; out: <%- or <%= to %>; lines: blocks as the brace rule folds them."""
    touches = F.contains(text, F.lit("<%")) | F.contains(text, F.lit("%>"))

    def left(sign: str) -> Callable[[Column], Column]:
        return lambda x: T.has(F.regexp_replace(x, rf"(?s){sign}.*?%>", "\n"), sign)

    rules = {"code": left("<%"), "out": left("<%[-=]"), "lines": B.ends_open}
    found = {}
    for name, ends_open in rules.items():
        # Lines end with the one that closes; the other two go on right after the sign.
        rest = _after(_after(text, "%>"), "\n") if name == "lines" else _after(text, "%>")
        none_left = F.locate("\n", _after(text, "%>")) == 0 if name == "lines" else F.lit(False)
        found[f"{name}0"] = F.when(touches, ends_open(text)).otherwise(False)
        found[f"{name}1"] = F.when(~touches | (F.locate("%>", text) == 0), True).when(none_left, False).otherwise(let(rest, ends_open))
    return found


_AUTOMATA = ("code", "out", "lines")


def _any_open(parts: DataFrame) -> DataFrame:
    """Light rows in ranges with _moves -> with _open: whether any block is open where the part begins.

    A part either sets what is open, or keeps it, or turns it over; so what holds is the last that was set, turned over
    as often as parts have done so since: a running sum and a last value, both carried from range to range.
    """
    turns = {f"_{a}_t": F.when(F.col(f"{a}0") & ~F.col(f"{a}1"), 1).otherwise(0) for a in _AUTOMATA}
    rows = running(parts, turns)
    scan = Window.partitionBy("book_id", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("book_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sets = {a: F.when(F.col(f"{a}0") == F.col(f"{a}1"), F.struct(F.col(f"{a}0").cast("int").alias("v"), F.col(f"_{a}_t").alias("t"))) for a in _AUTOMATA}
    lasts = rows.groupBy("book_id", "_range").agg(*[F.max_by(v, F.when(v.isNotNull(), F.col("_at"))).alias(f"_{a}_l") for a, v in sets.items()])
    lasts = lasts.select("book_id", "_range", *[F.last(f"_{a}_l", ignorenulls=True).over(earlier).alias(f"_{a}_e") for a in _AUTOMATA])
    rows = rows.withColumns({f"_{a}_s": F.last(v, ignorenulls=True).over(scan) for a, v in sets.items()}).join(lasts, ["book_id", "_range"])
    opened = F.lit(False)
    for a in _AUTOMATA:
        last, turned = F.coalesce(f"_{a}_s", f"_{a}_e"), F.col(f"_{a}_t") - turns[f"_{a}_t"]
        opened = opened | (F.coalesce(last["v"] + turned - last["t"], turned) % 2 == 1)
    return rows.withColumn("_open", opened).select("book_id", "_range", "_at", "_open")


_SIGN = "\x03"


def _residue(tokens: Column) -> Column:
    """Tag tokens (tag, closes, at) without those that open and close with nothing left between, which no rule can
    concern: what is left of parts, in order, has the findings of the whole.  For short runs: each step copies them."""

    def step(kept: Column, t: Column) -> tuple[Column, Column]:
        top = F.concat(F.lit("\x01"), t["tag"], F.lit("\x02"))
        last = F.substring_index(kept, "\x01", -1)
        cancels = t["closes"] & F.startswith(F.concat(F.lit("\x01"), last), top)
        shorter = F.substring(kept, F.lit(1), F.length(kept) - F.length(last) - 1)
        longer = F.concat(kept, F.lit("\x01"), F.when(t["closes"], _SIGN).otherwise(""), t["tag"], F.lit("\x02"), t["at"].cast("string"))
        return F.when(cancels, shorter).otherwise(longer), F.array().cast("array<int>")

    entries = F.filter(F.split(fold(tokens, F.lit(""), step, "int")["state"], "\x01", -1), lambda x: x != "")
    name = lambda x: F.substring_index(x, "\x02", 1)
    return F.transform(entries, lambda x: F.struct(F.replace(name(x), F.lit(_SIGN), F.lit("")).alias("tag"), F.startswith(x, F.lit(_SIGN)).alias("closes"), F.substring_index(x, "\x02", -1).cast("int").alias("at")))


def _tag_rows(left: DataFrame) -> DataFrame:
    """C3 to C5 of what pieces (book_id, _range, _at, tokens) leave unmatched, a row for each finding."""
    rows = running(left, {"_n": F.size("tokens").cast("bigint")})
    rows = rows.select("book_id", "_range", (F.col("_n") - F.size("tokens")).alias("_first"), F.posexplode("tokens").alias("i", "t"))
    rows = written(matched(rows.select("book_id", "_range", (F.col("_first") + F.col("i")).alias("_at"), "t.tag", "t.closes", F.col("t.at").alias("line"))), "tag-pairs")

    def told(found: DataFrame, code: str, message: Column) -> DataFrame:
        return found.select("book_id", F.struct(F.lit(code).alias("code"), F.lit("error").alias("level"), message.alias("message")).alias("f"))

    tag, line = F.col("tag"), F.col("line")
    return all_of([
        told(crossings(rows), "C3", _said("XML tag crossing: <", tag, "> not closed before </", F.col("other"), "> near line ", line)),
        told(rows.filter("not closes and mate is null"), "C4", _said("XML tag <", tag, "> unclosed near line ", line)),
        told(rows.filter("closes and mate is null"), "C5", _said("XML tag </", tag, "> has no open")),
    ])


def prompt_findings(parts: DataFrame) -> DataFrame:
    """Findings on assembled prompts, from their parts as `sections` gives them: those of `text_findings`.

    Parts are laid out in ranges; a prompt is cut wherever no block is open, so a row holds but the parts that an open
    block connects.  Counts and brace balances are added up; of tags, each piece passes on what it leaves unmatched,
    as rows.
    """
    order = ["section", "part_group", "part_kind", "part_rn", "part_line"]
    laid = in_ranges(parts.filter("text is not null").select("book_id", *order, "text"), [F.col(c) for c in order], "parts").drop(*order)
    text = F.col("text")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    light = written(laid.select("book_id", "_range", "_at", lines.cast("bigint").alias("lines"), *[v.alias(k) for k, v in _moves(text).items()]), "part-moves")
    begins = light.join(_any_open(light.drop("lines")), ["book_id", "_range", "_at"])
    begins = running(begins.select("book_id", "_range", "_at", "lines", F.when(F.col("_open"), 0).otherwise(1).alias("_new")), {"_piece": F.col("_new"), "_lines": F.col("lines")})
    begins = begins.select("book_id", "_range", "_at", "_piece", (F.col("_lines") - F.col("lines")).alias("before"))

    pieces = laid.join(begins, ["book_id", "_range", "_at"]).groupBy("book_id", "_piece").agg(
        F.min("before").alias("before"), F.min("_at").alias("_at"), F.min("_range").alias("_range"), F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("all")
    )
    pieces = pieces.withColumn("text", F.array_join(F.transform("all", lambda x: x["text"]), "\n")).drop("all")
    opens, closes = _macro_counts(text)
    tokens = F.transform(by_blocks(_lined_tokens(text), _residue), lambda t: F.struct(t["tag"].alias("tag"), t["closes"].alias("closes"), (t["at"] + F.col("before")).alias("at")))
    facts = written(pieces.select("book_id", "_range", "_at", b1(text, F.col("before")).alias("b1"), e2(text).alias("e2"), B.code_balance(text).alias("net"), opens.alias("opens"), closes.alias("closes"), tokens.alias("tokens")), "piece-facts")

    sums = facts.groupBy("book_id").agg(F.sum("net").alias("net"), F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))
    sums = sums.select("book_id", F.concat(_unbalanced(F.col("net")), _mismatched(F.col("opens"), F.col("closes"))).alias("f"))
    tags = _tag_rows(facts.filter(F.size("tokens") > 0).select("book_id", "_range", "_at", "tokens"))
    found = facts.select("book_id", F.concat("b1", "e2").alias("f")).unionByName(sums)
    return _assembled(found.select("book_id", F.explode("f").alias("f")).unionByName(tags))


STRICT = ["F1", "F2", "F3", "F4", "F5", "F7", "F8"]


def validate(entries: DataFrame, strict: bool = False) -> DataFrame:
    """All findings of a set of books: rules on entries, across entries and on the assembled prompts."""
    rows = E.complete(entries)
    found = [entry_findings(rows, ["D1", *(STRICT if strict else [])]), d2(rows), prompt_findings(sections(rows))]
    if strict:
        found.append(f6(rows))
    if "raw" in entries.columns and "map_key" in entries.columns:
        found.append(file_rules(entries))
    return all_of(found)


# Rules on the results of the four steps


def _exploded(facts: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Findings of rules (code, level, condition, message) on a row of facts per book."""
    said = [F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), message.alias("message"))) for code, level, bad, message in rules]
    found = facts.select("book_id", F.explode(F.array_compact(F.array(*said))).alias("f"))
    return found.select("book_id", F.col("f.code").alias("code"), F.col("f.level").alias("level"), F.lit("file").alias("scope"), F.lit(None).cast("bigint").alias("uid"), F.col("f.message").alias("message"))


def artifact_facts(rows: DataFrame) -> DataFrame:
    """A row per book: range and continuity of order and uid, and the border of static and dynamic entries; one
    aggregation for all."""
    label = T.entry_label(F.col("content"), F.col("comment"))
    rows = rows.select("book_id", "ord", "uid", label.isin("boundary", "supplement", "dynamic").alias("moving"))
    ranges = [x for c in ("ord", "uid") for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"), E.continuity(c).alias(f"{c}_ok"))]
    return E.bordered(rows, ranges)


def residual_field() -> Column:
    """The first temporary field of the steps that an entry still has."""
    return F.get(F.filter(F.array(*map(F.lit, P.TEMP_FIELDS)), lambda f: F.map_contains_key(F.col("raw"), f)), F.lit(0))


def check_artifact(entries: DataFrame) -> DataFrame:
    """P1, P2, P3 and P5 of a step's result.  Books without entries have no rows here; see missing_books."""
    facts = artifact_facts(E.complete(entries))
    lo, hi, n = F.col("ord_lo"), F.col("ord_hi"), F.col("n")
    ends_bad = (lo != 0) | (hi != n - 1)
    said = F.when(ends_bad, _said("order not continuous: range ", lo, "..", hi, ", expected 0..", n - 1)).otherwise("order not continuous")
    found = _exploded(facts, [
        ("P1", "error", ends_bad | ~F.col("ord_ok"), said),
        ("P2", "error", ~F.col("uid_ok"), F.lit("uid not continuous")),
        ("P5", "error", ~F.col("static_first"), _said("static entries (max order=", F.col("static_max"), ") after dynamic entries (min order=", F.col("dynamic_min"), ")")),
    ])
    if "raw" not in entries.columns:
        return found
    left = entries.withColumn("_f", residual_field()).filter("_f is not null")
    return found.unionByName(finding(left, "P3", "warning", "entry", _said("temporary field '", F.col("_f"), "' found"), F.col("uid")))


def missing_books(books: DataFrame, entries: DataFrame) -> DataFrame:
    """P0 for books (book_id) without entries."""
    return finding(books.join(entries.select("book_id").distinct(), "book_id", "left_anti"), "P0", "error", "file", F.lit("entries list is empty"))


def check_chain(analysis: DataFrame, split: DataFrame, reordered: DataFrame, merged: DataFrame, backups: DataFrame | None = None) -> DataFrame:
    """CH1 a step without a book's entries, CH2 counts that shrink or grow the wrong way, CH3 no backup (book_id)."""
    names = {"analysis": analysis, "split": split, "reordered": reordered, "merged": merged}
    rows = chain_counts(names)
    if backups is not None:
        rows = rows.unionByName(backups.select("book_id", F.lit("backup").alias("step"), F.lit(1).cast("bigint").alias("n")))
    facts = rows.groupBy("book_id").agg(*[F.max(F.when(F.col("step") == k, F.col("n"))).alias(k) for k in (*names, "backup")])
    rules = [("CH1", "error", F.col(k).isNull(), F.lit(f"{k} is missing")) for k in names] + _count_rules()
    if backups is not None:
        rules.append(("CH3", "warning", F.col("backup").isNull(), F.lit("no backup file found")))
    return _exploded(facts, rules)


def _count_rules() -> list[tuple[str, str, Column, Column]]:
    rules = []
    for a, b, sign in (("split", "analysis", "<"), ("reordered", "split", "<"), ("merged", "reordered", ">")):
        bad = F.col(a) < F.col(b) if sign == "<" else F.col(a) > F.col(b)
        rules.append(("CH2", "warning", bad, _said(f"{a} (", F.col(a), f") {sign} {b} (", F.col(b), ")")))
    return rules


def check_files(missing: DataFrame, counts: DataFrame, backups: DataFrame, names: DataFrame) -> DataFrame:
    """CH1 to CH3 on chains of files, as `chain_of_files` lists them: stem, code, level, scope, uid, message.  A chain
    that lacks a file has CH1 findings only."""
    whole = names.select("stem").distinct().join(missing, "stem", "left_anti")
    facts = whole.join(counts.groupBy("stem").agg(*[F.max(F.when(F.col("step") == k, F.col("n"))).alias(k) for k in ("analysis", "split", "reordered", "merged")]), "stem")
    absent = missing.select(F.col("stem").alias("book_id"), F.concat(F.lit("missing: "), "name").alias("m"))
    bare = whole.join(backups, "stem", "left_anti").select(F.col("stem").alias("book_id"))
    found = [finding(absent, "CH1", "error", "file", F.col("m")), _exploded(facts.withColumnRenamed("stem", "book_id"), _count_rules()), finding(bare, "CH3", "warning", "file", F.lit("no backup file found"))]
    return all_of(found).withColumnRenamed("book_id", "stem")


def quarantine(entries: DataFrame) -> DataFrame:
    """Entries that the steps take otherwise than they stand: Q1 a code block whose braces are out of all proportion, Q2
    and Q3 an order or position that is null or missing and gets its default.  One pass, row by row."""
    blocks = F.when(F.contains("content", F.lit("<%")), B.blocks_of(F.col("content")))
    given = {c: entries[c].isNull() if c in entries.columns else F.lit(True) for c in ("ord", "position")}
    bare = entries.select(*[v.alias(f"_no_{c}") for c, v in given.items()], "*")
    rows = E.complete(bare).withColumn("_bad", F.coalesce(B.bad_braces(blocks), F.lit(False)))
    told = [("Q1", "_bad", "code block braces out of proportion"), ("Q2", "_no_ord", "order is null, 100 is taken"), ("Q3", "_no_position", "position is null, 0 is taken")]
    said = [F.when(F.col(c), F.struct(F.lit(code).alias("code"), F.lit(m).alias("message"))) for code, c, m in told]
    found = rows.select("book_id", "uid", F.explode(F.array_compact(F.array(*said))).alias("f"))
    return found.select("book_id", F.col("f.code").alias("code"), F.lit("warning").alias("level"), F.lit("entry").alias("scope"), "uid", F.col("f.message").alias("message"))
