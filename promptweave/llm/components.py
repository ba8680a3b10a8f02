"""Connected components of a graph given as edges between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _sign(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(pairs: DataFrame, link_self: bool) -> DataFrame:
    """pairs (u, v), a written table: hang every v, and u itself if asked, under the least of u and its v's.

    The least ones are written before they are joined: then both sides of the join come straight from a shuffle, and
    Spark splits the partition of a hot u.
    """
    least = saved(pairs.groupBy("u").agg(F.min("v").alias("lowest")).select("u", F.least("u", "lowest").alias("m")), "least")
    members = pairs.filter("v > u") if not link_self else pairs
    hung = members.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    if link_self:
        hung = hung.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    hung = saved(hung.filter("a < b").distinct(), "edges")
    dropped(least)
    return hung


def component_roots(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): root is the least node reachable from node.

    Alternating large and small stars until the edge set no longer changes; O(log n) rounds in practice.  Each round
    is two aggregations that combine on the map side and two equi-joins of written tables, whose hot keys adaptive
    execution splits, so a star of any degree stays distributed.  Nodes without an edge do not appear; null ends and
    self loops are ignored; repeated edges count once; no edges give no rows.
    """
    now = saved(
        edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = _sign(now)
    while mark[0]:
        both = now.selectExpr("a as u", "b as v").unionByName(now.selectExpr("b as u", "a as v"))
        large = _star(both, link_self=False)
        small = _star(large.selectExpr("b as u", "a as v"), link_self=True)
        dropped(now, large)
        now = small
        before, mark = mark, _sign(now)
        if before == mark:
            break
    leaves = now.selectExpr("b as node", "a as root")
    return leaves.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
