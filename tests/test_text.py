"""Scalar functions over hand-made texts, all cases of a function in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from promptweave.functions import blocks as B
from promptweave.functions import patterns as P
from promptweave.functions import tags as G
from promptweave.functions import text as T



def each(spark, texts, col):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", col.alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


MARKED = {
    "<% if (x) { %>": ["<% if", "<%"], "<%_ if(x) %>": ["<% if", "<%"], "<%= v %>": ["<%="], "<%- v %>": ["<%-"], "<% x %>": ["<%"], "<%# note %>": [], "<%# getvar('x') %>": ["getvar("],
    "{{getvar::a}}": ["{{getvar::"], "{{setvar::a}}": ["{{setvar::"], "{{incvar::a}}": ["{{incvar::"], "{{xbgetvar_yaml_idx::a}}": ["{{xbgetvar_yaml_idx::"], "{{if a}}": ["{{if"], "{{iffy}}": [],
    "{{.x}}": ["{{."], "{{$x}}": ["{{$"], "getvar('a')": ["getvar("], "中getvar(": [], "xgetvar(": [], "setvar(": ["setvar("], "variables.x": ["variables."], "myvariables.x": [],
    "{{time}}": ["{{time}}"], "{{date}}": ["{{date}}"], "{{idleDuration}}": ["{{idleDuration}}"], "{{random::a}}": ["{{random"], "{{randomx}}": [], "{{roll 1}}": ["{{roll"],
    "{{format_message_variable::x}}": ["{{format_message_variable"], "{{input}}": ["{{input}}"], "{{lastMessage}}": ["{{lastMessage}}"], "{{lastMessageId}}": ["{{lastMessageId}}"],
    "{{lastUserMessage}}": ["{{lastUserMessage}}"], "{{lastCharMessage}}": ["{{lastCharMessage}}"], "{{bias x}}": ["{{bias"], "{{inject": ["{{inject"], "<state>": ["<state>"],
    "{{char}} {{user}}": [], "plain": [], "": [],
}


def test_markers(spark):
    assert each(spark, MARKED, T.markers(F.col("c"))) == list(MARKED.values())
    assert each(spark, MARKED, T.is_static(F.col("c"))) == [not m for m in MARKED.values()]


def test_plugins(spark):
    texts = ["@@iframe x", "@@if", "plain", "a @@private"]
    assert each(spark, texts, T.has_plugin(F.col("c"), F.lit(""))) == [True, True, False, True]
    comments = ["[GENERATE:BEFORE] x", "@INJECT pos", "x @INJECT", "[InitialVariables]", "plain"]
    assert each(spark, comments, T.has_plugin(F.lit(""), F.col("c"))) == [True, True, False, True, False]


def test_stripping(spark):
    assert each(spark, ["a<% x %>b", "a<%= x\n%>b", "a<% open"], T.without_code(F.col("c"))) == ["ab", "ab", "a<% open"]
    assert each(spark, ["a{{x}}b", "a{{x\n}}b", "{{a}}{{b}}c"], T.without_macros(F.col("c"))) == ["ab", "a{{x\n}}b", "c"]
    assert each(spark, ["　 a \n", "\x0b a b "], T.strip(F.col("c"))) == ["a", "a b"]


def test_net_braces(spark):
    cases = {"if (x) {": 1, "}": -1, "'{' + \"{\" + `{`": 0, "// {\n}": -1, "/* { */ {": 1, "'\\'{' {": 1, "'{ unclosed": 0, "": 0}
    assert each(spark, cases, T.net_braces(F.col("c"))) == list(cases.values())


def test_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i", "\n\n", "\r\n\r"]
    assert each(spark, texts, T.lines_of(F.col("c"))) == [t.splitlines(keepends=True) for t in texts]


def blocks(spark, texts):
    return [[(b.type, b.content, b.start_line, b.end_line, b.brace_delta) for b in bs] for bs in each(spark, texts, B.blocks_of(F.col("c")))]


def test_blocks(spark):
    got = blocks(spark, ["a\n<% if (x) { %>\nb\n<% } %>", "<% a\nb %> c %>\nd", "x <% open\nto the end", "", "<%= a %> mid <% { %>", "z %> <%- {\n%>"])
    assert got == [
        [("text", "a\n", 0, 0, 0), ("ejs", "if (x) {", 1, 1, 1), ("text", "b\n", 2, 2, 0), ("ejs", "}", 3, 3, -1)],
        [("ejs", "a\nb %> c", 0, 1, 0), ("text", "d", 2, 2, 0)],
        [("ejs", "open\nto the end", 0, 1, 0)],
        [],
        [("ejs", "a %> mid <% {", 0, 0, 1)],
        [("ejs", "{", 0, 1, 1)],
    ]


def test_ranges_and_classes(spark):
    texts = ["<% if (x) { %>\na\n<% } %>\nb", "<% if (x) { %>\na\n<% } %>", "<% { %>\na", "plain", "{{getvar::x}}", "text {{getvar::x}}", "<% } %>\n<% { %>\nz", "<%= a %>"]
    n = F.size(T.lines_of(F.col("c")))
    ranges = B.compound_ranges(B.blocks_of(F.col("c")), n)
    got = [[tuple(r) for r in rs] for rs in each(spark, texts, ranges)]
    assert got == [[(0, 2)], [(0, 2)], [(0, 1)], [], [], [], [], []]
    static, mixed = B.classified(F.col("c"), ranges, n)
    assert each(spark, texts, static) == [False, False, False, True, False, False, False, False]
    assert each(spark, texts, mixed) == [True, False, False, False, False, True, True, False]
    assert each(spark, texts, B.is_unclosed(B.blocks_of(F.col("c")))) == [False, False, True, False, False, False, False, False]
    assert each(spark, ["<% " + "{" * 20 + " %>", "<% " + "{" * 19 + " %>"], B.bad_braces(B.blocks_of(F.col("c")))) == [True, False]


def model_tags(text):
    """Pairs by a stack that a closing tag searches from the top."""
    import re

    stack, pairs = [], []
    for m in re.finditer(r"<(/?)([\w]+)>", text):
        if not m[1]:
            stack.append((m[2], m.start()))
            continue
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == m[2]), None)
        if at is not None:
            tag, start = stack.pop(at)
            pairs.append((tag, start, m.end()))
    return pairs


def test_tag_spans(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["<a>", "</a>", "<角>", "</角>", "<b_1>", "</b_1>", "x", "😀", "< c>", "<d/>"]) for _ in range(rng.randint(0, 20))) for _ in range(200)]
    got = [[tuple(t) for t in ts] for ts in each(spark, texts, G.tag_spans(F.col("c")))]
    assert got == [model_tags(t) for t in texts]
    longest = [max(m, key=lambda t: t[2] - t[1])[0] if (m := model_tags(t)) else None for t in texts]
    assert each(spark, texts, G.outermost(G.tag_spans(F.col("c")))) == longest


def test_segments(spark):
    texts = ["intro\n# A\nx\n## B \ny\n### C\nz", "# A\n", "", "no heading", "#A\n# \n#  B"]
    got = [[(s.level, s.heading, s.start_line, s.end_line) for s in ss] for ss in each(spark, texts, G.heading_segments(T.lines_of(F.col("c"))))]
    assert got == [[(None, "", 0, 0), (1, "A", 1, 2), (2, "B", 3, 6)], [(1, "A", 0, 0)], [], [(None, "", 0, 0)], [(None, "", 0, 1), (1, "B", 2, 2)]]


def test_segment_texts(spark):
    assert each(spark, ["<a>\n# H\n</a>", "# H\nbody", "", "#\nx"], T.is_bare(F.col("c"))) == [True, False, True, True]
    assert each(spark, ["<a>\nx\n</a>\n", "x <a> y\n", "\n\n<a>\n\nx"], T.without_tag_lines(F.col("c"))) == ["x\n", "x <a> y\n", "x"]


def test_boundaries(spark):
    cases = {
        "<暗部>": ("xml_open", "暗部", "<暗部>"), " </暗部> x": ("xml_close", "暗部", "</暗部>"), "<a>x</a>": None, "x <a>": None, "# 暗部开始": ("md_open", "暗部", "# 暗部开始"),
        "text\n## B  end ": ("md_close", "B", "## Bend"), "# start": None, "<a> <% if %>": ("xml_open", "a", "<a>"), "": None,
    }
    got = each(spark, cases, T.boundary(F.col("c")))
    assert [tuple(b) if b else None for b in got] == list(cases.values())
    assert each(spark, ["<a> <% x %>", "<a>"], T.static_boundary(F.col("c")).isNotNull()) == [False, True]
    assert each(spark, ["<a>", " </a> ", "# A开始", "<a>x", "# A"], T.is_copy_content(F.col("c"))) == [True, True, True, False, False]


def test_comments(spark):
    comments = ["a [split-static]", "a [split-static] [boundary-copy-open]", "合并:1-2", "[supplement-start]", "a [split-dynamic] b", ""]
    assert each(spark, comments, T.comment_base(F.col("c"))) == ["a", "a [split-static]", "合并:1-2", "[supplement-start]", "a [split-dynamic] b", ""]
    labels = each(spark, comments, T.entry_label(F.lit("plain"), F.col("c")))
    assert labels == ["static", "boundary", "merged", "supplement", "static", "static"]
    assert each(spark, ["x" * 3, "😀" * 5], T.preview(F.col("c"), 4)) == ["xxx", "😀😀😀😀...(truncated)"]


@pytest.mark.parametrize("wrong", ["user", "br", "content"])
def test_names_that_are_no_tags(wrong):
    assert wrong in P.NOT_TAGS
