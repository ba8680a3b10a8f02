"""tags of a book are rows, not one value, and lines are cut only where a rule needs them."""

import random

import pytest
from pyspark.sql import functions as F

from promptweave.functions import blocks as B
from promptweave.functions import patterns as P
from promptweave.functions import text as T
from promptweave.operators import crossings as C
from promptweave.plans import prompt, validate

BITS = [
    "<%", "%>", "<%=", "<%-", "<%#", "<% if", "{", "}", "{{", "}}", "{{time}}", "{{if", "getvar(", "x", "_", "é", "😀", " ", "\n", "\r\n", "\r", " ", " ", "\t",
    "<ab>", "</ab>", "<ij>", "<b>", "<state>", "# ", "## 夜", "开始", "end", "'", "variables.", "<", "%", ">",
]


def texts(spark, n, seed):
    rng = random.Random(seed)
    said = ["", "\n", "<ij>\nx\n<ij>", "<ij>\r\n", "<ij>\n<ij>\n", " <ab>  <ab> ", "<ij>\r<ij>"]
    rows = said + ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(rows)), "seq long, content string").withColumn("book_id", F.col("seq") % 3).repartition(4)


def test_cheaper_expressions_say_the_same(spark):
    c = F.col("content")
    lines = T.lines_of(c)
    blocks = F.filter(B.blocks_of(c), lambda b: b["type"] == "ejs")
    pairs = [
        (T.is_static(c), ~T.any_of([T.has(c, p) for _, p in P.MARKERS])),
        (B.ends_open(c), B._folded(lines, texts=False)["state"]["since"] >= 0),
        (B.code_balance(c), F.aggregate(blocks, F.lit(0), lambda a, b: a + b["brace_delta"])),
    ]
    for new, old in pairs:
        assert texts(spark, 3000, 1).select(new.alias("new"), old.alias("old"), c).filter("not new <=> old").collect() == []


def test_entry_rules_say_the_same(spark):
    c = F.col("content")
    rows = texts(spark, 3000, 2).withColumn("uid", F.col("seq"))
    lines, shape = T.lines_of(c), rf"\A<({P.NAME}+)>\z"
    first, last = (F.regexp_extract(T.strip(F.coalesce(F.try_element_at(lines, F.lit(n)), F.lit(""))), shape, 1) for n in (1, -1))
    want = {
        "D1": T.is_bare(c) & (T.strip(c) != ""),
        "F5": T.strip(c) == "",
        "F8": (F.size(lines) >= 2) & (first != "") & (first == last) & ~first.isin(P.NOT_TAGS),
    }
    for code, old in want.items():
        found = sorted(r.uid for r in validate.entry_findings(rows, [code]).collect())
        assert found and found == sorted(r.uid for r in rows.filter(old).collect()), code


def brute(tokens):
    """C3 (tag, other, line), of which one for each crossing, by a list of open tags."""
    opened, found = [], []
    for tag, closes, line in tokens:
        at = next((i for i in reversed(range(len(opened))) if opened[i][0] == tag), None)
        if not closes:
            opened.append((tag, line))
        elif at is not None:
            found += [(o, tag, n) for o, n in opened[at + 1 :]]
            del opened[at]
    return sorted(found)


@pytest.mark.parametrize("block", [2, 256])
def test_crossings_against_a_stack(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(5)
    books = {b: [(rng.choice("abcd"), rng.random() < share, i) for i in range(n)] for b, n, share in ((0, 400, 0.4), (1, 300, 0.7), (2, 1, 0.0), (3, 40, 0.5))}
    books[4] = [("a", False, i) for i in range(30)] + [("b", False, 30 + i) for i in range(20)] + [("a", True, 50 + i) for i in range(30)]
    rows = [(b, i // 50, i, *t) for b, ts in books.items() for i, t in enumerate(ts)]
    tokens = C.matched(spark.createDataFrame(rows, "book_id long, _range long, _at long, tag string, closes boolean, line int").repartition(4))
    found = [tuple(r) for r in C.crossings(tokens).select("book_id", "tag", "other", "line").collect()]
    assert sorted(found) == sorted((b, *x) for b, ts in books.items() for x in brute(ts))
    assert sum(x[0] == 4 for x in found) == 600


def test_no_crossings_without_pairs(spark):
    tokens = spark.createDataFrame([(1, 0, 0, "a", False, 1), (1, 0, 1, "b", True, 1)], "book_id long, _range long, _at long, tag string, closes boolean, line int")
    assert C.crossings(C.matched(tokens)).collect() == []


def test_a_book_of_unmatched_tags(spark, monkeypatch):
    rng = random.Random(9)
    bits = ["<a>", "</a>", "<b>", "</b>", "<c>", "</d>", "\n", "x"]
    rows = [(b, 2, 0, 1, i, 1, "".join(rng.choice(bits) for _ in range(rng.choice([3, 3, 3, 700])))) for b in range(3) for i in range(40)]
    parts = spark.createDataFrame(rows, "book_id long, section int, part_group long, part_kind int, part_rn long, part_line int, text string").repartition(4)
    want = sorted(map(str, validate.text_findings(prompt.prompt_text(parts)).collect()))

    def never(*_):
        raise AssertionError("the tags of a book in one row")

    monkeypatch.setattr(validate, "_tag_findings", never)
    assert sorted(map(str, validate.prompt_findings(parts).collect())) == want
