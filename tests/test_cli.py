import json

import pytest
from books import LIGHTHOUSE, LIGHTHOUSE_RESULT
from pyspark.sql import functions as F

from promptweave.__main__ import main
from promptweave.sources import artifacts


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("books")
    entries = {str(i): {"uid": i, "comment": c, "content": t, "order": o, "position": p, "depth": d} for i, (c, t, o, p, d) in enumerate(LIGHTHOUSE)}
    (top / "book.json").write_text(json.dumps({"entries": entries}))
    (top / "new.json").write_text(json.dumps({"entries": {str(r[0]): {"uid": r[0], "order": r[0], "position": r[1], "depth": r[2], "role": r[3], "constant": r[4], "key": r[5], "comment": r[6], "content": r[7]} for r in LIGHTHOUSE_RESULT}}))
    (top / "chat.json").write_text('{"chat": [{"role": "user", "content": "hello"}]}')
    return top


def run(spark, *args):
    return list(main([str(a) for a in args], spark))


def test_pipeline(spark, files):
    out = files / "out"
    told = run(spark, "pipeline", "-i", f"{files}/book.json", "-d", out)
    assert [x.split(":")[0] for x in told] == ["[1/4] analysis", "[2/4] split", "[3/4] reordered", "[4/4] merged"]
    names = sorted(p.name for p in out.iterdir() if not p.name.startswith("."))
    assert names == [f"book_{step}.json" for step in ("analysis", "merged", "reordered", "split")]
    merged = json.loads((out / "book_merged.json").read_text())["entries"]
    assert list(merged) == [str(r[0]) for r in LIGHTHOUSE_RESULT]
    assert [(e["uid"], e["order"], e["displayIndex"], e["content"]) for e in merged.values()] == [(r[0], r[0], r[0], r[7]) for r in LIGHTHOUSE_RESULT]
    analysis = json.loads((out / "book_analysis.json").read_text())
    assert analysis["source"] == "book.json" and analysis["summary"] == {"total": 13, "static": 8, "dynamic": 1, "mixed": 4}
    keeper = analysis["entries"][3]
    assert keeper["suggested_split"] and keeper["split_boundaries"][1]["heading"] == "History" and set(keeper) == {
        "uid", "comment", "is_static", "is_mixed", "detected_markers", "suggested_split", "ejs_compound_ranges", "split_boundaries",
    }
    assert len(list(files.glob("book.backup_*.json"))) == 1
    # Again, over what is there: the same files, and no second backup of the same content.
    before = (out / "book_merged.json").read_text()
    run(spark, "pipeline", "-i", f"{files}/book.json", "-d", out)
    assert (out / "book_merged.json").read_text() == before and len(list(files.glob("book.backup_*.json"))) == 1
    assert artifacts.read_artifacts(spark, str(out), "merged").select("stem").distinct().collect() == [("book",)]
    assert artifacts.read_analysis(spark, f"{out}/*_analysis.json").filter("suggested_split").select("uid").collect() == [(3,)]


def test_many_books(spark, tmp_path):
    for name, entries in (("a b%+世", {"0": {"uid": 0, "content": "x"}}), ("empty", {}), ("list", [{"content": "y"}, {"content": "{{time}}"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"entries": entries}))
    run(spark, "pipeline", "-i", f"{tmp_path}/*.json")
    assert json.loads((tmp_path / "a b%+世_merged.json").read_text())["entries"]["0"]["content"] == "x"
    assert json.loads((tmp_path / "empty_merged.json").read_text()) == {"entries": {}}
    # A static and a dynamic entry, and the wrapper around what is dynamic.
    assert len(json.loads((tmp_path / "list_merged.json").read_text())["entries"]) == 4
    report = run(spark, "validate", "--pipeline-dir", tmp_path)
    assert [x for x in report if "Pipeline check" in x] == ["  Pipeline check: a b%+世", "  Pipeline check: empty", "  Pipeline check: list"]
    assert report.count("  ✓ All checks passed") == 3 and "  _analysis      : 2 entries" in report
    (tmp_path / "list_split.json").unlink()
    (tmp_path / "empty_merged.json").write_text('{"entries": {"0": {}, "1": {}}}')
    for p in tmp_path.glob("a b*.backup_*"):
        p.unlink()
    told = [x for x in run(spark, "validate", "--pipeline-dir", tmp_path) if x.startswith(("  ✗", "  ⚠"))]
    assert told == ["  ⚠ [CH3] no backup file found", "  ⚠ [CH2] merged (2) > reordered (0)", "  ✗ [CH1] missing: list_split.json"]
    one = run(spark, "validate", "--pipeline-dir", tmp_path, "--pipeline-name", "nowhere", "--output-errors", tmp_path / "errors")
    assert len([x for x in one if "[CH1] missing: nowhere_" in x]) == 4
    document = json.loads(next((tmp_path / "errors").glob("part-*")).read_text())
    assert (document["source"], document["total_errors"], document["pass"]) == ("nowhere", 4, False)


def test_failed_writes_leave_files_whole(spark, tmp_path):
    (tmp_path / "a_merged.json").write_text("old")
    texts = spark.createDataFrame([("a_merged.json", "new"), ("b_merged.json", None)], "name string, value string")
    with pytest.raises(Exception, match="boom"):
        artifacts.write_files(texts.withColumn("value", F.expr("coalesce(value, raise_error('boom'))")), str(tmp_path))
    assert (tmp_path / "a_merged.json").read_text() == "old" and not list(tmp_path.glob(".staged-*"))
    assert artifacts.write_files(texts.filter("value is not null"), str(tmp_path)) == 1
    assert (tmp_path / "a_merged.json").read_text() == "new\n"
    with pytest.raises(ValueError, match="a_merged.json"):
        artifacts.write_files(texts.withColumn("name", F.lit("a_merged.json")), str(tmp_path))


def test_lists(spark, files):
    book = f"{files}/book.json"
    csv = run(spark, "list", "-i", book, "--csv", "--filter", "dynamic")
    assert csv[:2] == ["order,pos,depth,static,constant,uid,comment", "31,4,20,✗,✗,7,clock"] and len(csv) == 6
    table = run(spark, "list", "-i", book)
    assert table[0].split() == ["Order", "Pos", "Depth", "Static", "Const", "UID", "Comment"] and table[1] == "─" * 80 == table[-2]
    assert table[-1] == "Summary: 13 entries (8 static, 5 dynamic)" and len(table) == 17
    assert len(table[0].split("Comment")[0]) == len(table[2]) - len(table[2].split("  ")[-1])  # the head stands over its columns
    found = run(spark, "query", "-i", book, "--filter", "static", "--order-range", "50", "60")
    assert found[0].split() == ["#", "Order", "Pos", "Depth", "Type", "Const", "Dis", "UID", "Comment"]
    assert found[-1] == "Total: 2 entries (static=2)" and run(spark, "query", "-i", book)[-1] == "Total: 13 entries (dynamic=5, static=8)"
    assert run(spark, "query", "-i", book, "--search", "nothing has this")[-1] == "Total: 0 entries ()"
    assert run(spark, "query", "-i", book, "--filter", "static", "--order-range", "50", "60", "--csv")[:2] == ["order,pos,depth,type,constant,disable,uid,comment", "50,0,4,static,✗,✗,9,stairs"]
    assert run(spark, "query", "-i", book, "--summary-only") == ["total=13  static=8  dynamic=5  order: min=1 max=62 continuous=no  uid: min=0 max=12 continuous=yes  temp_field_residue: none"]
    assert run(spark, "query", "-i", book, "--summary-only", "--filter", "dynamic") == ["total=5  order: 3..61"]
    assert run(spark, "query", "-i", f"{files}/new.json", "--summary-only", "--filter", "boundary")[0].startswith("total=2  boundary=2  order: ")
    assert len(run(spark, "list-full", "-i", book, "-u", "8")) == 1
    assert run(spark, "list-full", "-i", book, "-u", "99") == ["[NOT FOUND] No entry with uid=99"]
    assert run(spark, "list-full", "-i", book, "-s", "zzz") == ['[NOT FOUND] No entry matching "zzz"']
    assert run(spark, "list-full", "-i", book, "-u", "8", "--filter", "dynamic") == []


def test_checks_and_prompt_files(spark, files):
    assert run(spark, "query", "-i", f"{files}/new.json", "--verify") == ["✓ 产物完整性验证通过"]
    bad = run(spark, "query", "-i", f"{files}/book.json", "--verify")
    assert bad[0] == "✗ order 不连续: 范围 1..62, 条目数 13" and bad[-1].startswith("✗ 静态条目 (max order=62)")
    report = run(spark, "validate", "-i", f"{files}/book.json", "--pipeline-check")
    assert [x[2:6] for x in report if x.startswith("  [")] == ["[P1]", "[P5]"] and report[-2].startswith("  FAIL")
    report = run(spark, "validate", "-i", f"{files}/book.json", "--strict")
    assert report[:3] == ["=" * 60, "  World book validation: book.json", "=" * 60] and report[-3:-1] == ["  Result: 0 errors, 5 warnings", "  PASS"]
    assert run(spark, "validate", "-i", f"{files}/none.json")[4:6] == ["[ERRORS] (1):", f"  [A0] assembled: File not found: {files}/none.json"]
    got = run(spark, "prompt", "-C", "-i", f"{files}/new.json", "--chat-history", f"{files}/chat.json")
    assert "用户: hello" in got[0] and len(run(spark, "prompt", "-C", "--scenario", "here", "-i", f"{files}/book.json")) == 1


def test_diff(spark, files):
    both = ["diff", "--original", f"{files}/book.json", "--optimized", f"{files}/new.json"]
    report = run(spark, *both)
    assert report[:3] == ["═" * 70, "  Diff: book.json → new.json", "═" * 70] and report[4] == "  13 条原始条目, 按 6 键排序" and report[6].startswith("  #0 ")
    assert "  ── 边界副本 (2 条, 管线自动生成) ──" in report and "  ── 补充包裹 (2 条, 管线自动生成) ──" in report
    at = report.index("  ── 汇总 ──")
    assert report[at + 1].startswith("  拆分: 1 条 → 2 子条") and report[at + 4] == "  新建: 4 条" and report[-1] == "═" * 70
    told = json.loads(run(spark, *both, "-f", "json", "--max-order-changes", 3)[0])
    assert list(told) == ["original", "optimized", "entry_count", "matches", "created", "removed"] and told["entry_count"] == {"before": 13, "after": 14}
    assert next(m for m in told["matches"] if m["uid"] == 3)["targets"] == [{"uid": 8, "role": "split-dynamic"}, {"uid": 2, "role": "merged"}]
    assert sorted(c["type"] for c in told["created"]) == ["boundary_copy", "boundary_copy", "supplement", "supplement"] and told["removed"] == []
    tree = run(spark, *both, "--from-uid", "3")
    assert tree[4] == "  向前追踪: 1 条" and any(x.startswith("  " + "─" * 60 + "\n  ┌─ keeper\n  │  uid=3") and x.endswith("→ 拆分") for x in tree)
    assert [x.split("\n")[1] for x in tree if "├─" in x] == ["  ├─ [动态部分]", "  ├─ [合并入]"] and tree[-2:] == ["  └──\n", "═" * 70]
    assert "  (无匹配条目)" in run(spark, *both, "--to-search", "深")
    back = run(spark, *both, "--to-uid", "2")
    assert any("条原始条目合并而来" in x for x in back) and any(x.startswith("  │    ← \"") for x in back)
    assert json.loads(run(spark, *both, "--summary")[0])["n_split"] == 1
