import random
import re

from helpers import sentence

import corpus_pipeline
from promptweave.llm import sentencepieces


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def holds(text, item):
    """Whether a run of the text's words is within a fifth of the item's words, rounded down, in edits."""
    words, want = (re.findall(r"\w+", (t or "").lower()) for t in (text, item))
    row = [0] * (len(words) + 1)
    for i, w in enumerate(want, 1):
        new = [i]
        for j, v in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (v != w)))
        row = new
    return min(row) <= len(want) // 5


def brute(rows, toxic_word, items):
    """The first four stages by their definitions, without the operators."""
    rows = [r for r in rows if toxic_word not in (r[1] or "")]
    best = {}
    for r in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        if n not in best or (-len(r[1] or ""), r[0]) < (-len(best[n][1] or ""), best[n][0]):
            best[n] = r
    rows = sorted(best.values())
    sets = {r[0]: shingles(r[1]) for r in rows}
    group = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
                    group[a] = group[b] = min(group[a], group[b])
    rows = [r for r in rows if group[r[0]] == r[0]]
    return {r[0]: r[1] for r in rows if not any(holds(r[1], t) for _, t in items)}


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    item = sentence(rng, 25)
    base = sentence(rng, 500).split()
    rows = [(i, sentence(rng, 40) + (" moron" if i % 5 == 0 else "")) for i in range(120)]
    rows += [(200 + i, " ".join(w if rng.random() > 0.004 else "new" for w in base)) for i in range(8)]
    near = sentence(rng, 200).split()
    rows += [(250 + i, " ".join("other" if k in range(5, 5 + 11 * i, 11) else w for k, w in enumerate(near))) for i in range(7)]  # 5 shingles a change
    rows += [(300, "same text"), (301, "same  text"), (302, None), (303, ""), (304, f"x {item} y"), (305, sentence(rng, 30) + " " + item)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(rows, "moron", [(1, item)])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    with open(sentencepieces.MODEL_PATH, "rb") as f:
        model = sentencepieces.Model(f.read())
    assert all(r.ids == model.lib.encode(want[d] or "") and r.round_trip for d, r in got.items())


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_run_on_edge_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, two texts under one id and a column of a clashing name."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, ""), (None, "no id"), (None, None), (3, "x y"), (3, "other words here"), (4, " "), (5, "你好 世界 " * 3000)]
    docs = spark.createDataFrame([(d, t, None, None, None, "k") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, keep_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Blank texts are copies of the longest of them, and rows under one id, also under none, share what becomes of them.
    assert sorted(r.doc_id for r in got) == [1, 1, 3, 3, 4, 5]
    again = docs.limit(0)
    again.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
