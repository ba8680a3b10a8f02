"""What large books and long texts take: substrings by anchors, order by ranges, prompts by parts."""

import random

import pytest
from books import LIGHTHOUSE, LIGHTHOUSE_RESULT, book, step
from pyspark.sql import functions as F

from promptweave.operators import boundaries as D
from promptweave.operators import entries as E
from promptweave.operators import substrings as S
from promptweave.operators.ordered import in_ranges, numbered, ranked, running
from promptweave.plans import pipeline, prompt, validate

SHOWN = ["seq", "position", "depth", "role", "constant", "key", "comment", "content"]


@pytest.fixture
def eight(spark):
    """Eight partitions that stay eight, however small."""
    keys = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def brute_contained(texts, holders):
    return sorted({(b, t, h, m.find(t)) for b, t in texts for c, h, m in holders if b == c and t in m})


def found(spark, texts, holders):
    texts = spark.createDataFrame(texts, "book_id long, text string")
    hits = S.contained(texts, spark.createDataFrame(holders, "book_id long, holder long, text string"))
    told = texts.distinct().withColumn("key", S.key_of(F.col("text"))).join(hits, ["book_id", "key"])
    return sorted((r.book_id, r.text, r.holder, r.place) for r in told.collect())


def test_contained(spark):
    rng = random.Random(5)
    holders = [(b, h, "".join(rng.choice("ab é\n中😀") for _ in range(rng.randint(0, 400)))) for b in (1, 2) for h in range(6)]
    texts = [(rng.choice((1, 2)), m[a : a + rng.choice((1, 2, 7, 15, 16, 17, 40, 63, 64, 65, 200))]) for _ in range(150) for _, _, m in [rng.choice(holders)] for a in [rng.randrange(len(m) + 1)]]
    texts = [x for x in texts if x[1]] + [(1, "zzz"), (3, "a"), (1, "aa" * 100)]
    assert found(spark, texts, holders) == brute_contained(texts, holders)


def test_contained_in_long_holders(spark):
    """Across pieces of holders, at their ends, in repetitive ones, and beside texts that differ in one character."""
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 * S.PIECE + 11))
    holders = [(1, 1, long), (1, 2, "x" * 20_000), (1, 3, long[:-1])]
    cuts = [(0, len(long)), (S.PIECE - 3, S.PIECE + 3), (S.PIECE, 2 * S.PIECE), (len(long) - 90, len(long)), (5, 5 + S.PIECE)]
    texts = [(1, long[a:z]) for a, z in cuts] + [(1, "x" * 19_999), (1, "x" * 20_001), (1, long[:5000] + "?" + long[5001:9000]), (2, "x")]
    assert found(spark, texts, holders) == brute_contained(texts, holders)
    assert found(spark, texts, [(1, 1, ""), (9, 1, "x")]) == []


def test_places_of_one_book_by_ranges(eight):
    rng = random.Random(1)
    rows = eight.createDataFrame([(1, i, rng.randint(0, 30)) for i in range(2000)] + [(2, 0, 5)], "book_id long, seq long, ord long").repartition(8)
    laid = in_ranges(rows, [F.col("ord"), F.col("seq")], "test")
    assert laid.filter("book_id = 1").select("_range").distinct().count() >= 7  # over the tasks, not in one
    want = sorted(map(tuple, ranked(rows, [F.col("ord"), F.col("seq")], ranges=False).collect()))
    assert sorted(map(tuple, numbered(laid, "rn").collect())) == want
    odd = sorted(map(tuple, numbered(laid.filter("seq % 2 = 1"), "rn").select("seq", "rn").collect()))
    assert [r for _, r in sorted(odd, key=lambda x: x[1])] == list(range(1000))
    sums = running(laid, {"x": F.col("ord")}).orderBy("_at").select("book_id", "ord", "x").collect()
    total = {1: 0, 2: 0}
    for r in sums:
        total[r.book_id] += r.ord
        assert r.x == total[r.book_id]


def test_steps_by_ranges(eight):
    rng = random.Random(3)
    parts = ["<A>", "</A>", "<B>", "</B>", "# X开始", "# X结束", "{{roll}}", "plain", "plain two"]
    many = [(rng.choice("ab"), rng.choice(parts), rng.randint(0, 60), rng.choice([0, 4, 4, 6]), rng.choice([None, 1, 4, 20])) for _ in range(300)]
    rows = book(eight, many, 1).unionByName(book(eight, many[::-1][:150], 2)).unionByName(book(eight, LIGHTHOUSE, 7))
    whole = E.complete(rows)
    pairs = sorted(map(str, D.boundary_pairs(whole).collect()))
    assert len(pairs) > 50 and pairs == sorted(map(str, D.boundary_pairs(whole, ranges=True).collect()))
    got = step(pipeline.pipeline(rows, ranges=True), "book_id", *SHOWN)
    assert got == step(pipeline.pipeline(rows, ranges=False), "book_id", *SHOWN)
    assert [r[1:] for r in got if r[0] == 7] == LIGHTHOUSE_RESULT
    nothing = pipeline.pipeline(rows.limit(0), ranges=True)
    assert nothing.count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_findings_by_parts(eight, seed):
    """Blocks, tags and macros that run on from part to part, as in the whole prompt."""
    rng = random.Random(seed)
    bits = ["<%", "%>", "<%=", "<%-", " x ", "{", "}", "{{", "}}", "<a>", "</a>", "<b>", "</b>", "\n", "'", "text", "<%= {{y}} %>", "<", "%"]
    rows = [(b, 2, 0, 1, i, 1, "".join(rng.choice(bits) for _ in range(rng.randint(0, 5 if seed else 12)))) for b in range(10) for i in range(rng.choice([1, 5, 40]))]
    parts = eight.createDataFrame(rows, "book_id long, section int, part_group long, part_kind int, part_rn long, part_line int, text string")
    want = sorted(map(str, validate.text_findings(prompt.prompt_text(parts)).collect()))
    assert want and sorted(map(str, validate.prompt_findings(parts).collect())) == want
