"""Text functions on columns: markers, stripping, boundaries, labels.  Native expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def has(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def strip(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(c, rf"\A{P.WS}+|{P.WS}+\z", "")


def markers(content: Column) -> Column:
    """Names of the dynamic markers in content, in reporting order."""
    return F.array_compact(F.array(*[F.when(has(content, p), F.lit(n)) for n, p in P.MARKERS]))


def is_static(content: Column) -> Column:
    """No marker.  Most texts hold none of the strings that markers need and stop at that; the others are searched for
    the markers that start with what they hold."""
    return ~any_of([any_of([F.contains(content, F.lit(h)) for h in hints]) & has(content, p) for hints, p in P.MARKER_STARTS])


def has_plugin(content: Column, comment: Column) -> Column:
    by_comment = [F.contains(comment, F.lit(x)) for x in P.PLUGIN_COMMENTS] + [F.startswith(comment, F.lit(P.PLUGIN_COMMENT_START))]
    return any_of(by_comment + [F.contains(content, F.lit(x)) for x in P.PLUGIN_DECORATORS])


def without_code(content: Column) -> Column:
    """Without closed code blocks."""
    return F.regexp_replace(content, r"(?s)<%[-_=#]?.*?%>", "")


def without_macros(content: Column) -> Column:
    """Without macros; none spans lines."""
    return F.regexp_replace(content, r"(?d)\{\{.*?\}\}", "")


def residue(content: Column) -> Column:
    return without_macros(without_code(content))


def without_literals(code: Column) -> Column:
    """Code with each string literal and comment turned into one blank."""
    return F.regexp_replace(code, P.CODE_LITERALS, " ")


def net_braces(code: Column) -> Column:
    """Opening minus closing braces outside literals."""
    bare = without_literals(code)
    return F.length(F.replace(bare, F.lit("}"), F.lit(""))) - F.length(F.replace(bare, F.lit("{"), F.lit("")))


def lines_of(content: Column) -> Column:
    """array<string> of lines with their ends; none for an empty text."""
    return F.regexp_extract_all(content, F.lit(P.LINE), F.lit(0))


def is_bare(segment: Column) -> Column:
    """Nothing but tags, headings and white space."""
    no_tags = F.regexp_replace(segment, rf"</?{P.NAME}+>", "")
    return strip(F.regexp_replace(no_tags, rf"(?dm)^#{{1,2}}{P.WS}.*$", "")) == ""


def without_tag_lines(segment: Column) -> Column:
    """Without lines that are one tag; white space around them, line ends included, goes too."""
    return F.regexp_replace(segment, rf"(?dm)^{P.WS}*</?{P.NAME}+>{P.WS}*$\n?", "")


def xml_boundary(content: Column) -> Column:
    """struct<kind, name, copy> of a text that starts with a tag whose counterpart is missing, else null."""
    text = strip(content)
    opened, closed = (F.regexp_extract(text, rf"\A<{s}({P.NAME}+)>", 1) for s in ("", "/"))
    return F.when(
        (opened != "") & ~F.contains(text, F.concat(F.lit("</"), opened, F.lit(">"))),
        F.struct(F.lit("xml_open").alias("kind"), opened.alias("name"), F.concat(F.lit("<"), opened, F.lit(">")).alias("copy")),
    ).when(
        (closed != "") & ~F.contains(text, F.concat(F.lit("<"), closed, F.lit(">"))),
        F.struct(F.lit("xml_close").alias("kind"), closed.alias("name"), F.concat(F.lit("</"), closed, F.lit(">")).alias("copy")),
    )


def md_boundary(content: Column) -> Column:
    """struct<kind, name, copy> of the first line that is an opening or closing heading, else null."""
    found = F.filter(F.transform(lines_of(strip(content)), strip), lambda x: has(x, "(?d)" + P.MD_BOUNDARY))
    line = F.get(found, F.lit(0))
    marks, base, word = (F.regexp_extract(line, "(?d)" + P.MD_BOUNDARY, n) for n in (1, 2, 3))
    base = strip(base)
    kind = F.when(word.isin(P.OPEN_WORDS), "md_open").otherwise("md_close")
    return F.when(line.isNotNull(), F.struct(kind.alias("kind"), base.alias("name"), F.concat(marks, F.lit(" "), base, word).alias("copy")))


def boundary(content: Column) -> Column:
    """Boundary of a text, tags first.  Dynamic texts count too."""
    return F.coalesce(xml_boundary(content), md_boundary(content))


def static_boundary(content: Column) -> Column:
    """Boundary of a static text, else null."""
    return F.when(is_static(content), boundary(content))


def is_copy_content(content: Column) -> Column:
    """Exactly one tag, or one opening or closing heading."""
    text = strip(content)
    return has(text, rf"\A</?{P.NAME}+>{P.WS}*\z") | has(text, "(?d)" + P.MD_BOUNDARY)


def comment_base(comment: Column) -> Column:
    """Comment without one derivation suffix at its end."""
    return strip(F.regexp_replace(comment, rf"{P.WS}*\[(split-static|split-dynamic|boundary-copy-open|boundary-copy-close)\]$", ""))


def is_split_static(comment: Column) -> Column:
    return F.contains(comment, F.lit(P.SPLIT_STATIC))


def is_split_dynamic(comment: Column) -> Column:
    return F.contains(comment, F.lit(P.SPLIT_DYNAMIC))


def is_merged(comment: Column) -> Column:
    return F.startswith(comment, F.lit(P.MERGED))


def is_copy(comment: Column) -> Column:
    return F.contains(comment, F.lit(P.COPY))


def is_supplement(comment: Column) -> Column:
    return F.contains(comment, F.lit(P.SUPPLEMENT))


def short_label(comment: Column, uid: Column, order: Column, position: Column) -> Column:
    """First forty characters of the comment, with uid, order and position."""
    shown = [F.coalesce(x.cast("string"), F.lit("?")) for x in (uid, order, position)]
    return F.concat(F.substring(comment, 1, 40), F.lit(" (uid="), shown[0], F.lit(" order="), shown[1], F.lit(" pos="), shown[2], F.lit(")"))


def preview(content: Column, most: int = 500) -> Column:
    """Content, cut after `most` code points."""
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("...(truncated)"))).otherwise(content)


def entry_label(content: Column, comment: Column) -> Column:
    """merged, boundary, supplement, static or dynamic; the first that holds."""
    return (
        F.when(is_merged(comment), "merged")
        .when(is_copy(comment), "boundary")
        .when(is_supplement(comment), "supplement")
        .when(is_static(content), "static")
        .otherwise("dynamic")
    )


def mark(flag: Column) -> Column:
    return F.when(flag, "✓").otherwise("✗")
