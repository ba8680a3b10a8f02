import json

from books import LIGHTHOUSE, LIGHTHOUSE_RESULT

from promptweave.streaming.books import arriving_books, rerun


def test_books_that_arrive(spark, tmp_path):
    entries = {str(i): {"comment": c, "content": t, "order": o, "position": p, "depth": d} for i, (c, t, o, p, d) in enumerate(LIGHTHOUSE)}
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"entries": entries}))
        rerun(arriving_books(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("book_id").distinct().count() == 2
    for _, rows in got.toPandas().sort_values("seq").groupby("book_id"):
        assert list(rows["content"]) == [r[7] for r in LIGHTHOUSE_RESULT]
