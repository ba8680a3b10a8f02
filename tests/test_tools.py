"""Listings, prompts, validation and lineage over hand-made books."""

import pytest
from books import LIGHTHOUSE, book
from pyspark.sql import functions as F

from promptweave.operators import entries as E
from promptweave.plans import lineage, listing, pipeline, prompt, validate
from promptweave.sources import books as S


def lines(df):
    return [r.line for r in df.orderBy("book_id", "rn").collect()]


def test_listing(spark):
    rows = book(spark, [("b", "{{time}}", 2, 0, 4), ("a", "x", 1, 0, None)]).withColumn("uid", F.col("seq") + 10)
    assert lines(listing.listing_csv(listing.listing(rows))) == ["1,0,None,✓,✗,11,a", "2,0,4,✗,✗,10,b"]
    assert lines(listing.listing_table(listing.listing(rows, False))) == ["    2    0      4       ✗       ✗    10  b"]
    assert tuple(listing.listing_summary(listing.listing(rows)).first()) == (1, 2, 1, 1)
    full = listing.full_listing(rows, search="X", most=0).collect()
    assert [(r.uid, r.label, r.preview) for r in full] == [(11, "Content preview (0/1 chars):", "...(truncated)")]
    assert [r.uid for r in listing.full_listing(rows, uid=10, search="X").collect()] == [10]


def test_query(spark):
    rows = book(spark, [("a", "Needle", 5, 0, 4), ("needle b", "{{time}}", 3, 4, 4), ("合并:1-2", "x", 4, 0, 4)])
    assert [r.comment for r in listing.query(rows, search="needle").collect()] == ["needle b"]
    assert [r.comment for r in listing.query(rows, order_range=(4, 5)).orderBy("rn").collect()] == ["合并:1-2", "a"]
    assert [r.label for r in listing.query(rows, label="merged").collect()] == ["merged"]
    assert lines(listing.query_csv(listing.query(rows)))[0] == "3,4,4,dynamic,✗,✗,1,needle b"


def test_summaries(spark):
    whole = pipeline.pipeline(book(spark, LIGHTHOUSE))
    got = E.summary(whole).first()
    assert (got.total, got.n_static, got.n_dynamic, got.n_supplement, got.n_merged) == (14, 1, 5, 2, 4)
    assert got.ord_continuous and got.uid_continuous and E.frontier(whole).first().static_first
    assert validate.check_artifact(whole).count() == 0


def test_prompt_order(spark):
    rows = book(spark, [(f"p{p}", f"text{p}", 10 - p, p, 2) for p in range(8)] + [("deep", "deep", 0, 4, 9)])
    chat = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 2, "tool", "x")], "book_id long, turn long, role string, text string")
    card = spark.createDataFrame([(1, '{"description": "D", "scenario": " S "}')], "book_id long, value string")
    parts = prompt.sections(rows, chat=chat, system=" sys ", persona="me", card=S.character_card(card))
    assert prompt.prompt_text(parts).first().text.split("\n") == [
        "sys", "text0", "me", "D", "[Character Personality Placeholder]", "S", "text1", "text5", "text6", "deep", "text4", "用户: hi", "角色: ho", "tool: x", "text2", "text3",
    ]
    silent = prompt.prompt_text(prompt.sections(rows, chat=chat.limit(0))).first().text
    assert "deep" not in silent and "text0" in silent
    told = prompt.prompt_text(prompt.sections(rows, comments=True)).first().text
    assert told.startswith("<!-- ============ [1/12] System Prompt ============ -->\n[System Prompt Placeholder]\n\n<!-- ============ [2/12]")
    assert '<!--   injected: Entry uid=8 order=0 comment="deep" pos=4 depth=9 -->' in told and told.endswith("<!-- 总计: 12 段, 2 个 WI 条目注入 -->")


def test_chat_files(spark):
    files = spark.createDataFrame([(1, '{"chat": [{"content": "a"}, {"role": "system"}]}'), (2, '{"messages": [{"role": "x", "content": "y"}]}'), (3, "{}")], "book_id long, value string")
    assert sorted(map(tuple, S.chat_messages(files).collect())) == [(1, 0, "user", "a"), (1, 1, "system", ""), (2, 0, "x", "y")]


def found(df):
    return sorted((r.code, r.uid, r.message) for r in df.collect())


def test_entry_rules(spark):
    rows = book(spark, [("a", "<A>\nx\n<A>", 1, 0, 12), ("b", "{{time}}", 1, 4, 4), ("c", " ", 1, 0, 12), ("d", "# H\n<T>", 2, 4, 1)]).withColumns(
        {"constant": F.lit(True), "key": F.when(F.col("seq") == 1, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")), "use_probability": F.lit(True), "probability": F.lit(50)}
    )
    got = {(c, u) for c, u, _ in found(validate.validate(rows, strict=True)) if c[0] in "DF"}
    assert got == {("F8", 0), ("F4", 0), ("F2", 0), ("F1", 1), ("F5", 2), ("F4", 2), ("F2", 2), ("F6", 2), ("D1", 3), ("F2", 3)}
    assert all(c != "F1" for c, _, _ in found(validate.validate(rows)))


def test_heading_pairs(spark):
    rows = book(spark, [("a", "# X开始", 1, 0, 4), ("b", "# X结束", 2, 0, 4), ("c", "# Y start", 3, 0, 4), ("d", "# Z end", 4, 0, 4), ("e", "# Z end", 5, 0, 4), ("f", "text\n# W开始", 6, 0, 4)])
    assert found(validate.d2(E.complete(rows)).fillna(-1)) == [("D2", -1, "MD boundary #Z结束 has no matching start"), ("D2", -1, "MD boundary #Z结束 has no matching start"), ("D2", 2, "MD boundary #Y开始 has no matching end")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\n<% x %>\n<% open", ["B1 EJS block not closed near line 3"]),
        ("<% { %>", ["B2 EJS brace unbalanced: net=1"]),
        ("<A><B></A></B>", ["C3 XML tag crossing: <B> not closed before </A> near line 1"]),
        ("x\n<A>", ["C4 XML tag <A> unclosed near line 2"]),
        ("</A>", ["C5 XML tag </A> has no open"]),
        ("<br> </user>", []),
        ("{{a}} {{", ["E1 Macro brace mismatch: opens=2, closes=1"]),
        ("<%= {{x}} %>", ["B2 EJS brace unbalanced: net=0", "E2 EJS output block contains nested macro: <%= {{x}} %>"][1:]),
    ],
)
def test_text_rules(spark, text, want):
    df = spark.createDataFrame([(1, text)], "book_id long, text string")
    assert sorted(f"{r.code} {r.message}" for r in validate.text_findings(df).collect()) == want


def test_file_rules(spark):
    files = spark.createDataFrame([(1, '{"entries": {"0": {"uid": 0, "content": "x"}, "1": {"uid": 5}, "2": {"content": ""}}}')], "book_id long, value string")
    assert found(validate.file_rules(S.parse_books(files)).fillna(-1)) == [("A3", -1, "uid=None != entries key=2"), ("A3", 5, "uid=5 != entries key=1"), ("A4", 5, "content field missing")]


def test_artifact_rules(spark):
    rows = book(spark, [("a", "{{time}}", 0, 0, 4), ("b", "x", 2, 0, 4)])
    assert [c for c, _, _ in found(validate.check_artifact(rows).fillna(-1))] == ["P1", "P5"]
    left = spark.createDataFrame([(1, '{"entries": {"0": {"uid": 0, "order": 0, "content": "x", "_pair_id": 1, "_is_static": true}}}')], "book_id long, value string")
    assert found(validate.check_artifact(S.parse_books(left))) == [("P3", 0, "temporary field '_is_static' found")]
    assert [r.code for r in validate.missing_books(spark.createDataFrame([(1,), (9,)], "book_id long"), rows).collect()] == ["P0"]


def test_chain_rules(spark):
    rows = book(spark, LIGHTHOUSE)
    split = pipeline.split(rows)
    assert validate.check_chain(rows, split, split, rows, rows.select("book_id").distinct()).count() == 0
    got = found(validate.check_chain(split, rows, rows.limit(0), split, rows.select("book_id").limit(0)).fillna(-1))
    assert [m for _, _, m in got] == ["reordered is missing", "split (13) < analysis (14)", "no backup file found"]
    assert S.artifact_name("book", "merged") == "book_merged"
    with pytest.raises(ValueError):
        S.artifact_name("book", "other")


def test_lineage(spark):
    rows = book(spark, LIGHTHOUSE)
    result = pipeline.pipeline(rows).persist()
    got = [(r.orig_uid, r.type, r.role, r.opt_uid) for r in lineage.forward(rows, result).orderBy("orig_uid", "opt_uid").collect()]
    assert got == [
        (0, "merged", "merged", 2), (1, "merged", "merged", 0), (2, "kept", "kept", 12), (3, "split", "merged", 2), (3, "split", "split-dynamic", 8), (4, "merged", "merged", 4), (5, "merged", "merged", 4),
        (6, "kept", "kept", 7), (7, "kept", "kept", 6), (8, "merged", "merged", 0), (9, "kept", "kept", 1), (10, "merged", "merged", 3), (11, "kept", "kept", 10), (12, "merged", "merged", 3),
    ]
    assert tuple(lineage.summary(rows, result).first()) == (1, 1, 2, 7, 4, 5, 0, 4)
    back = {}
    for r in lineage.reverse(rows, result).orderBy("opt_uid", "nth").collect():
        back.setdefault(r.opt_uid, []).append(r.orig_uid)
    assert back[0] == [8, 1] and back[3] == [10, 12] and back[4] == [5, 4] and back[8] == [3] and back[5] == back[9] == [None] and back[7] == [6]
    changed = {r.orig_rn: r.changes for r in lineage.kept_changes(rows, result).collect()}
    assert "position: 0 → 4; depth: 4 → 0; role: None → 1" in changed.values()
    result.unpersist()


def test_lineage_of_unknown_and_empty(spark):
    rows = book(spark, [("a", "", 1, 2, 4), ("b", "gone", 2, 0, 4), ("", "same text", 3, 0, 4)])
    new = book(spark, [("合并:1-2", "x", 1, 2, 4), ("other", " same text ", 2, 0, 4)])
    got = {r.orig_uid: (r.type, r.opt_uid) for r in lineage.forward(rows, new).collect()}
    assert got == {0: ("merged", 0), 1: ("unknown", None), 2: ("kept", 1)}
