"""lines and starts of segments are computed once a text."""

from pyspark.sql import functions as F

from promptweave.functions import tags as G
from promptweave.functions import text as T


def test_lines_are_cut_once(spark):
    rows = spark.createDataFrame([("# a\nx\n## b",), ("x\n### c\n# d\n",), ("",)], "c string")
    found = rows.select(G.heading_segments(T.lines_of(F.col("c"))).alias("s"))
    assert found._jdf.queryExecution().analyzed().toString().count("split(") <= str(rows.select(T.lines_of(F.col("c")))._jdf.queryExecution().analyzed().toString()).count("split(")
    assert [[tuple(x) for x in r.s] for r in found.collect()][0] == [(1, "a", 0, 1), (2, "b", 2, 2)]
