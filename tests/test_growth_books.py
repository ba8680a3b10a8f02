"""F11 to F13, F10: how much of a book or a holder one task holds."""

import pyarrow as pa
from pyspark.sql import functions as F

from promptweave.operators import ordered
from promptweave.operators import substrings as S


def test_books_of_forty_thousand_go_by_ranges(spark):
    rows = spark.range(40_000).select(F.lit(1).cast("bigint").alias("book_id"), F.col("id").alias("seq"))
    assert ordered.by_ranges(rows) and not ordered.by_ranges(rows.limit(30_000))
    assert not ordered.by_ranges(rows, ordered.SORTED_ROWS)


def test_pieces_of_a_holder_go_out_in_batches():
    text = "".join(chr(97 + i % 26) for i in range(S.PIECE * (S.PIECES + 1) + 5))
    batch = pa.RecordBatch.from_pydict({"book_id": [1], "holder": [2], "text": [text]})
    out = list(S._piece_batches(iter([batch])))
    assert [b.num_rows for b in out] == [S.PIECES, 2]
    assert "".join(p for b in out for p in b.column("piece").to_pylist()) == text
    assert [n for b in out for n in b.column("no").to_pylist()] == list(range(S.PIECES + 2))
