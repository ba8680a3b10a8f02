"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, read_table, text_or_empty


_SHIFT, _STEP = 2**63, 10**20


def normalised(text: Column) -> Column:
    """text without white space.  Bytes are replaced in place of a pattern, which would copy each text to UTF-16 and back."""
    return reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit("")), SPACES, text)


def _sha(name: str) -> Column:
    return F.coalesce(F.sha2(name, 256), F.lit(""))  # declared as never null: no filter hashes the text a second time


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, others ignored): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space.  They are grouped by the 128-bit MD5 of that form.  The
    bytes are compared by grouping on (hash, bytes) once: copies within a task fold before the shuffle, so each
    task sends a repeated text once, however hot it is.  A hash under which two byte strings stand is a collision;
    its rows are then told apart by the bytes themselves.  All later joins carry hashes, never texts.

    The row with the most code points in the original text stays, then the smallest doc_id.  Null text counts as
    empty.  A null doc_id loses every tie.  Rows repeated under one doc_id share one decision and all count
    in group_size.  An empty table gives no rows.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", F.length(text).alias("n_points"), normalised(text).alias("body")).withColumn("h", F.coalesce(F.unhex(F.md5("body")), F.lit(b"")))
    # One fixed-width number orders by (most code points, smallest id, null id last), so the aggregation hashes.
    order = F.expr(f"cast(2147483648 - n_points as decimal(10, 0)) * cast({_STEP} as decimal(21, 0)) + coalesce(cast(doc_id as decimal(20, 0)) + {_SHIFT}, {2 * _SHIFT})")
    bodies = rows.groupBy("h", "body").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    best_id = F.expr(f"cast(nullif(best % {_STEP}, {2 * _SHIFT}) - {_SHIFT} as bigint)")
    bodies = bodies.select("h", _sha("body").alias("text_sha256"), "group_size", best_id.alias("keep_id"))
    keyed = rows.select("doc_id", "h", _sha("body").alias("text_sha256"))
    # (h, text_sha256) names one byte string: 384 bits, of which the grouping above has compared the bytes.
    found = keyed.join(bodies, ["h", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies; columns as they were.  Of rows repeated under one doc_id all stay or go together."""
    gone = exact_groups(docs.select("doc_id", "text")).filter(~F.col("kept")).select(F.col("doc_id").alias("_pw_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_pw_id"]), "left_anti")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents
), g AS (
  SELECT body, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -n_points, b := doc_id)) AS keep_id FROM d GROUP BY body
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256 FROM d JOIN g ON d.body = g.body
"""
