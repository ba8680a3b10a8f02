"""The `entries` view: prompt entries laid over the documents table, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The documents hold no markers, so the view supplies them.  Engines agree on this text; the document is taken whole.
ENTRIES_SQL = """
WITH d AS (
  SELECT doc_id % 8 AS book_id, CAST(floor(doc_id / 8) AS BIGINT) AS uid, source, text AS t FROM documents
), v AS (
  SELECT *, CAST(uid % 16 AS INT) AS k FROM d
)
SELECT book_id, uid, uid AS seq,
  concat(source, '-', CAST(uid AS VARCHAR(20))) AS comment,
  (uid * 7) % 64 * 10 AS ord,
  CAST(CASE WHEN k BETWEEN 3 AND 6 THEN 0 WHEN uid % 17 = 16 THEN 7 WHEN uid % 3 = 0 THEN 4 ELSE uid % 7 END AS INT) AS position,
  CAST(CASE WHEN uid % 11 = 0 THEN NULL WHEN uid % 5 = 0 THEN 99 WHEN uid % 5 = 1 THEN 10 ELSE uid % 10 END AS INT) AS depth,
  uid % 9 = 0 AS constant, uid % 13 = 12 AS disable,
  CASE k
    WHEN 0 THEN '<%= getvar("tide") %>'
    WHEN 1 THEN concat('{{getvar::wind}} ', t)
    WHEN 2 THEN concat('<角色>', chr(10), '## 介绍', chr(10), t, chr(10), '## 状态', chr(10), 'lv <%- getvar("lv") %>', chr(10), '</角色>')
    WHEN 3 THEN '<灯塔>'
    WHEN 4 THEN '</灯塔>'
    WHEN 5 THEN '# 夜航开始'
    WHEN 6 THEN '# 夜航结束'
    WHEN 7 THEN concat('{{char}} ', t)
    WHEN 8 THEN concat('<% if (variables.stage>2) { %>', chr(10), t, chr(10), '<% } else { %>', chr(10), 'B', chr(10), '<% } %>')
    WHEN 9 THEN concat('## 标题', chr(10), t, chr(10), '<% if (x) { %>', chr(10), 'y<% getvar("y") %>')
    WHEN 10 THEN concat('<A>', chr(10), '# 静态', chr(10), t, chr(10), '# 动态', chr(10), 'z <%= v %>', chr(10), '</A>', chr(10), 'tail')
    WHEN 11 THEN concat('@@preprocessing', chr(10), t, ' {{time}}')
    WHEN 12 THEN ''
    WHEN 13 THEN '{{if calm}}the sea rests{{/if}}'
    ELSE t END AS content
FROM v
"""


# The same entries with mistakes planted, so that every rule of the validation has something to find.
FLAWED_SQL = """
WITH plain AS (ENTRIES), f AS (
  SELECT *, CAST(uid % 48 AS INT) AS m, book_id = 5 AND uid = 24 AS tail FROM plain
)
SELECT book_id, CASE WHEN book_id = 7 AND uid = 3 THEN uid + 100000 ELSE uid END AS uid, seq, comment,
  CASE WHEN tail THEN 9999 WHEN uid % 20 = 19 THEN 5 ELSE ord END AS ord,
  CAST(CASE WHEN tail THEN 3 WHEN uid % 20 = 19 THEN 0 ELSE position END AS INT) AS position,
  CAST(CASE WHEN uid % 20 = 19 THEN 1 ELSE depth END AS INT) AS depth,
  constant, disable, uid % 18 = 0 AS keyed,
  CAST(CASE WHEN uid % 14 = 0 THEN 50 ELSE 100 END AS INT) AS probability, uid % 7 = 0 AS use_probability,
  CASE WHEN tail THEN concat('tail ', comment, ' <% if (x) ')
    WHEN m = 14 THEN concat('# 孤立', CAST(uid AS VARCHAR(20)), '开始')
    WHEN m = 15 THEN concat('## 独行', CAST(uid AS VARCHAR(20)), '结束')
    WHEN m = 16 THEN concat('<ij>', chr(10), comment, chr(10), '<ij>')
    WHEN m = 17 THEN concat('<ab>', chr(10), '<cd> ', comment, '</ab>', chr(10), '</cd>')
    WHEN m = 18 THEN concat('<ef>', chr(10), comment)
    WHEN m = 21 THEN concat(comment, '</gh>')
    WHEN m = 22 THEN concat('{{a}} ', content, ' {{b')
    WHEN m = 23 THEN concat('<%= {{x}} ', comment, ' %>')
    WHEN m = 30 THEN comment
    ELSE content END AS content
FROM f
""".replace("ENTRIES", ENTRIES_SQL)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files make fewer partitions than there are cores; larger tables stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    query = sql.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}")
    return spark.sql(query, documents=spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def entries_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ENTRIES_SQL)


def flawed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, FLAWED_SQL)
    return rows.withColumn("key", F.when(F.col("keyed"), F.array(F.lit("k"))).otherwise(F.array().cast("array<string>"))).drop("keyed")
