"""Tags of a book as rows: which opens and closes belong together, and which pairs are crossed by other open tags.

No row or task holds the tags of a book.  A closing tag takes the nearest open one of its name, so names are matched by
themselves: on each depth of a name, opens and closes take turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptweave.tables import written

from .ordered import running

#: Open tags in one row of the join that makes crossings.
BLOCK = 256
_NEVER = (1 << 63) - 1


def matched(tokens: DataFrame) -> DataFrame:
    """tokens (book_id, _range, _at, tag, closes, ...), _at unique in the book and growing along its order -> with mate:
    the _at of the other tag of its pair, or null."""
    rows = running(tokens, {"_depth": F.when(F.col("closes"), -1).otherwise(1)}, ["book_id", "tag"])
    rows = rows.withColumn("_depth", F.when(F.col("closes"), F.col("_depth") + 1).otherwise(F.col("_depth")))
    turns = Window.partitionBy("book_id", "tag", "_depth").orderBy("_at")
    return rows.withColumn("mate", F.when(F.col("closes"), F.lag("_at").over(turns)).otherwise(F.lead("_at").over(turns))).drop("_depth")


def _inside(levels: int) -> Column:
    """array<struct<level, node>>: the fewest nodes of a binary tree over all places that cover those between _at and mate."""
    nodes = []
    for k in range(levels):
        low, high = F.shiftright(F.col("_at") + (1 << k), k), F.shiftright("mate", k)
        nodes.append(F.when((low < high) & (low % 2 == 1), F.struct(F.lit(k).alias("level"), low.alias("node"))))
        nodes.append(F.when((low < high) & (high % 2 == 1), F.struct(F.lit(k).alias("level"), (high - 1).alias("node"))))
    return F.array_compact(F.array(*nodes))


def crossings(tokens: DataFrame) -> DataFrame:
    """tokens as `matched` gives them, with line -> book_id, tag, line, other: for each pair (of name other) the tags that
    are opened within it and not closed before its end.

    A pair asks a few nodes of a tree over the places.  In a node tags are ordered by where they close, the last first, so
    those that outlast a pair are the first n; they are joined in blocks.  The work is that of sorting and of the rows
    that come out, which may be the square of the tags.
    """
    opens = tokens.filter("not closes")
    pairs = opens.filter("mate is not null")
    levels = (pairs.agg(F.max(F.col("mate") - F.col("_at"))).first()[0] or 0).bit_length()
    if not levels:
        return opens.select("book_id", "tag", "line", F.col("tag").alias("other")).limit(0)
    above = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("_at", k).alias("node")) for k in range(levels)])
    asked = pairs.select("book_id", F.explode(_inside(levels)).alias("at"), F.lit(0).alias("held"), F.col("mate").alias("ends"), "_at", "tag", "line")
    held = opens.select("book_id", F.explode(above).alias("at"), F.lit(1).alias("held"), F.coalesce("mate", F.lit(_NEVER)).alias("ends"), "_at", "tag", "line")
    rows = asked.unionByName(held).select("book_id", "at.level", "at.node", "held", "ends", "_at", "tag", "line")
    node = ["book_id", "level", "node"]
    last_first = Window.partitionBy(*node).orderBy(F.col("ends").desc(), "_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.withColumn("n", F.sum("held").over(last_first)).filter("n > 0").drop("ends", "_at"), "crossing-nodes")

    block = F.expr(f"(n - 1) div {BLOCK}")
    blocks = rows.filter("held = 1").groupBy(*node, block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "tag", "line"))).alias("all"))
    asked = rows.filter("held = 0").select(*node, F.col("tag").alias("other"), "n", F.explode(F.sequence(F.lit(0).cast("bigint"), block)).alias("block"))
    first = F.slice("all", F.lit(1), F.least(F.col("n") - F.col("block") * BLOCK, F.lit(BLOCK)).cast("int"))
    found = asked.join(blocks, [*node, "block"]).select("book_id", "other", F.explode(first).alias("x"))
    return found.select("book_id", "x.tag", "x.line", "other")
