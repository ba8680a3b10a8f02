"""The four steps over hand-made books."""

import json
import random

import pytest
from books import LIGHTHOUSE, LIGHTHOUSE_RESULT, book, step
from pyspark.sql import functions as F

from promptweave.operators import boundaries as D
from promptweave.operators import entries as E
from promptweave.plans import pipeline
from promptweave.sources import books as S

SHOWN = ["seq", "position", "depth", "role", "constant", "key", "comment", "content"]


def test_hand_traced_book(spark):
    rows = book(spark, LIGHTHOUSE)
    assert tuple(pipeline.analysis_summary(pipeline.analyze(rows)).first())[1:] == (13, 8, 1, 4)
    split = pipeline.split(rows)
    reordered = pipeline.reorder(split)
    merged = pipeline.merge(reordered)
    assert (split.count(), reordered.count(), merged.count()) == (14, 18, 14)
    assert step(merged, *SHOWN) == LIGHTHOUSE_RESULT


def test_books_do_not_mix(spark):
    two = book(spark, LIGHTHOUSE, 1).unionByName(book(spark, LIGHTHOUSE, 2))
    got = step(pipeline.pipeline(two), "book_id", *SHOWN)
    assert [r[1:] for r in got if r[0] == 1] == [r[1:] for r in got if r[0] == 2] == LIGHTHOUSE_RESULT


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_partitions_do_not_matter(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert step(pipeline.pipeline(book(spark, LIGHTHOUSE).repartition(parts)), *SHOWN) == LIGHTHOUSE_RESULT
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_files_keep_what_they_hold(spark):
    entries = {str(i): {"uid": i, "comment": c, "content": t, "order": o, "position": p, "depth": d, "odd": {"b": 1, "a": [2]}, "delayUntilRecursion": False} for i, (c, t, o, p, d) in enumerate(LIGHTHOUSE)}
    files = spark.createDataFrame([(1, json.dumps({"entries": entries, "other": 1}))], "book_id long, value string")
    got = json.loads(S.book_json(pipeline.pipeline(S.parse_books(files))).first().value)["entries"]
    assert list(got) == [str(i) for i in range(14)]
    assert [(e["order"], e["uid"], e["displayIndex"], e["content"]) for e in got.values()] == [(r[0], r[0], r[0], r[7]) for r in LIGHTHOUSE_RESULT]
    assert got["1"]["odd"] == {"b": 1, "a": [2]} and got["1"]["delayUntilRecursion"] is False
    assert "odd" not in got["0"] and got["0"]["groupWeight"] == 100 and len(got["0"]) == 42


def test_files_of_both_shapes(spark, tmp_path):
    shapes = {"map": {"entries": {"7": {"content": "x", "uid": 7}, "3": {"uid": None}}}, "list": {"entries": [{"content": "a"}, {"content": "b"}]}, "none": {"x": 1}}
    for name, doc in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    rows = S.read_books(spark, str(tmp_path))
    assert sorted((r.map_key, r.content) for r in rows.collect()) == [("0", "a"), ("1", "b"), ("3", None), ("7", "x")]
    (tmp_path / "bad.json").write_text("{no json")
    (tmp_path / "odd.json").write_text('{"entries": 5}')
    assert sorted(r.code for r in S.damaged_books(spark, str(tmp_path)).collect()) == ["A1", "A2"]
    S.write_books(rows.filter("map_key in ('0', '1')"), str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out")).collect()
    assert [len(json.loads(r.value)["entries"]) for r in again] == [2]


def test_analysis_of_unclosed_code(spark):
    rows = book(spark, [("a", "# A\nx\n# B\n<% if (x) { %>\ny", 1, 0, 4), ("b", "# A\nx\n# B\n<%= y %>", 2, 0, 4), ("c", "# A\nx\n# B\n<%= y %>", 3, 7, 4), ("d", "# A\n@@iframe\n# B\n<%= y %>", 4, 0, 4)])
    got = step(pipeline.analyze(rows), "is_static", "is_mixed", "suggested_split")
    assert got == [(False, True, False), (False, True, True), (False, False, False), (False, False, False)]


def test_split_after_a_closing_tag(spark):
    rows = book(spark, [("t", "<Log>\n# Kept\nink\n# Moving\nwave<%= var %>\n</Log>\nlast words", 1, 0, 4)])
    cuts = pipeline.analyze(rows).select(F.explode_outer("boundaries").alias("b")).select("b.*").collect()
    assert [(c.start_line, c.end_line, c.is_dynamic, c.wrap_tag) for c in cuts] == [(0, 0, False, "Log"), (1, 2, False, "Log"), (3, 5, True, "Log"), (6, 6, True, None)]
    assert step(pipeline.split(rows), "comment", "content") == [
        ("t [split-static]", "<Log>\n# Kept\nink\n\n</Log>"),
        ("t [split-dynamic]", "<Log>\n# Moving\nwave<%= var %>\n\n</Log>\n\nlast words"),
    ]


def test_split_by_a_given_analysis(spark):
    rows = E.complete(book(spark, LIGHTHOUSE))
    given = pipeline.analyze(rows).withColumn("suggested_split", F.lit(False))
    assert pipeline.split(rows, given).count() == 13
    doubled = given.unionByName(pipeline.analyze(rows).withColumn("seq", F.col("seq") + 100))
    assert step(pipeline.split(rows, doubled), "content") == step(pipeline.split(rows), "content")


NESTED = [("outer", "<A>", 1, 0, 4), ("inner", "<B>", 2, 0, 4), ("moving", '<%= getvar("x") %>', 3, 0, 4), ("inner end", "</B>", 4, 0, 4), ("outer end", "</A>", 5, 0, 4)]


def test_nested_boundaries(spark):
    rows = book(spark, NESTED)
    assert [(r.name, r.open_seq, r.close_seq, r.has_dynamic) for r in D.boundary_pairs(E.complete(rows)).orderBy("pair_no").collect()] == [("B", 1, 3, True), ("A", 0, 4, True)]
    got = [c for (c,) in step(pipeline.reorder(rows), "comment")]
    copies = ["outer [boundary-copy-open]", "inner [boundary-copy-open]", "moving", "inner end [boundary-copy-close]", "outer end [boundary-copy-close]"]
    assert got == ["outer", "inner", "inner end", "outer end", "[supplement-start]", *copies, "[supplement-end]"]
    merged = step(pipeline.merge(pipeline.reorder(rows)), "comment", "content")
    assert len(merged) == 8 and merged[0] == ("合并:0-3", "<A>\n\n<B>\n\n</B>\n\n</A>")


def test_boundaries_without_dynamic_entries(spark):
    still = [e for e in NESTED if e[0] != "moving"]
    assert D.boundary_copies(E.complete(book(spark, still))).count() == 0
    assert pipeline.reorder(book(spark, still)).count() == 4
    across = [("a", "<A>", 1, 0, 4), ("d", "{{time}}", 2, 0, 4), ("b", "</A>", 3, 1, 4)]
    assert D.boundary_pairs(E.complete(book(spark, across))).count() == 0


def test_pairs_against_a_stack(spark):
    rng = random.Random(7)
    data, want = [], []
    for b in range(40):
        stack = {}
        for i in range(rng.randint(0, 25)):
            name, opens, pos = rng.choice("ABC"), rng.random() < 0.5, rng.randint(0, 1)
            data.append((b, i, "c", f"<{name}>" if opens else f"</{name}>", i // 2, pos, 4))
        for pos in (0, 1):
            stack = []
            for r in sorted((r for r in data if r[0] == b and r[5] == pos), key=lambda r: (r[4], r[1])):
                name = r[3].strip("</>")
                if not r[3].startswith("</"):
                    stack.append((name, r[1]))
                else:
                    at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                    if at is not None:
                        want.append((b, stack.pop(at)[1], r[1]))
    rows = E.complete(spark.createDataFrame(data, "book_id long, seq long, comment string, content string, ord long, position int, depth int"))
    assert sorted((r.book_id, r.open_seq, r.close_seq) for r in D.boundary_pairs(rows).collect()) == sorted(want)


def test_depth_rules_and_sort(spark):
    rows = book(spark, [(f"d{d}", f"depth {d}", 10 * i, 4, d) for i, d in enumerate([0, 1, 9, 10, 9999, None])])
    assert step(pipeline.reorder(rows), "comment", "depth", "role") == [("d9999", 9999, 1), ("d10", 9999, 1), ("dNone", 0, 1), ("d9", 0, 1), ("d1", 0, 1), ("d0", 0, 1)]
    assert [c for (c,) in step(pipeline.merge(pipeline.reorder(rows)), "comment")] == ["合并:0-1", "合并:2-5"]


def test_outlets_stay_untouched(spark):
    rows = book(spark, [("o", "{{time}}", 5, 7, 3), ("s", "x", 1, 4, 3), ("w", "y", 2, 7, 30)])
    got = {c: rest for c, *rest in step(pipeline.reorder(rows), "comment", "position", "depth", "constant", "role")}
    assert got["o"] == [7, 3, False, None] and got["w"] == [7, 30, False, None] and got["s"] == [4, 0, True, 1]


def test_steps_again_keep_their_count(spark):
    once = pipeline.pipeline(book(spark, LIGHTHOUSE))
    assert pipeline.reorder(once).count() == once.count()
    assert pipeline.merge(once).count() == once.count()


def test_disabled_entries_do_not_merge(spark):
    rows = book(spark, [("a", "x", 1, 0, 4), ("b", "y", 2, 0, 4), ("c", "z", 3, 0, 4)]).withColumn("disable", F.col("seq") == 1)
    assert step(pipeline.merge(rows), "comment", "content", "disable") == [("合并:1-3", "x\n\nz", False), ("b", "y", True)]


def test_empty_books(spark):
    rows = book(spark, LIGHTHOUSE).limit(0)
    assert pipeline.pipeline(rows).count() == 0
