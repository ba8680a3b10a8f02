"""What the stages of the pipeline leave on the disk and in memory."""

from promptweave.llm import common, sentencepieces, shingle_sets


def test_near_links_leaves_no_prefixes_behind(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text), (2, text + " thirteen"), (3, "other words")], "doc_id long, text string")
    before = set(common._PATHS)
    marks, roots = shingle_sets.near_links(docs)
    left = {p.split("promptweave-")[1].split("-")[0] for p in set(common._PATHS) - before}
    assert "shingles" not in left and "nodes" in left
    assert sorted(r["doc_id"] for r in marks.collect()) == [1, 2, 3] and len(roots.collect()) == 2


def test_few_texts_are_encoded_at_once(spark):
    import pyarrow as pa

    with open(sentencepieces.MODEL_PATH, "rb") as f:
        shared = type("B", (), {"value": f.read()})
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": [f"word {i}" for i in range(200)]})
    out = list(sentencepieces._encode_small(shared, "bpe", True)(iter([batch])))
    assert [b.num_rows for b in out] == [64, 64, 64, 8]
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(200))
