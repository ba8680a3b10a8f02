"""URL filters: dated list entries become validity intervals; every capture is judged by the entries active when it
was fetched.  DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

#: Most intervals that are broadcast; a longer list is joined by a shuffle that adaptive execution can split.
BROADCAST_ROWS = 100_000
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_FIRST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)"

# A list as it changed over the year, (key, category, action, second of the change).  A key is a domain,
# which holds for its subdomains, or a domain and the first part of a path.
LIST_EVENTS = [
    ("cheap-pills.example.com", "spam", "add", 1704067200),
    ("cheap-pills.example.com", "spam", "remove", 1711929600),
    ("cheap-pills.example.com", "spam", "add", 1719792000),
    ("adult-x.example.net", "adult", "add", 1709251200),
    ("free-bets.example.com", "gambling", "add", 1706745600),
    ("free-bets.example.com", "gambling", "remove", 1727740800),
    ("spam-farm.example.org", "spam", "add", 1701388800),
    ("spam-farm.example.org", "malware", "add", 1714521600),
    ("spam-farm.example.org", "malware", "remove", 1717200000),
    ("example.org/es", "review", "add", 1712016000),
    ("example.org/es", "review", "remove", 1722470400),
    ("blog.tionsh.example.net", "trusted", "add", 1706745600),
    ("tionsh.example.net", "review", "add", 1709251200),
    ("tionsh.example.net", "review", "add", 1714521600),
    ("tionsh.example.net", "review", "remove", 1725148800),
]
#: Categories that let a capture pass where they stand on a key at least as long as any other active one.
TRUSTED = "trusted"

_VALUES = ", ".join(f"('{k}', '{c}', '{a}', {t})" for k, c, a, t in LIST_EVENTS)
_EVENTS_SQL = f"SELECT * FROM (VALUES {_VALUES}) AS e(key, category, action, since)"
#: The pages carry no fetch time; a second of 2024 is derived from the id.
_FETCHED = "1704067200 + (page_id * 86413) % 31536000"


def intervals(events: DataFrame) -> DataFrame:
    """events (key, category, action add or remove, since) -> (key, category, valid_from, valid_to); valid_to null: open.

    A change holds until the next one of its key and category; of changes at one time a removal comes last, and a
    repeated change counts once.  Events with a null key, time or another action are void.
    """
    good = events.filter("key is not null and since is not null and action in ('add', 'remove')")
    good = good.select(F.lower("key").alias("key"), F.coalesce("category", F.lit("")).alias("category"), "action", "since").distinct()
    after = F.lead("since").over(Window.partitionBy("key", "category").orderBy("since", "action"))
    spans = good.withColumn("valid_to", after).filter("action = 'add' and (valid_to is null or valid_to > since)")
    return spans.select("key", "category", F.col("since").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (id, url, fetched_at) -> id, url, fetched_at, host, n_active, categories, verdict, one row per row.

    A capture meets the entries of its host, of every parent domain of two labels or more, and of each of these with
    the first part of its path, as of fetched_at: from valid_from on, before valid_to.  verdict: `allow` if a trusted
    entry stands on a key at least as long as any other active one; else `block` if any is active; else `none`.  A
    null url, one without host and a null fetched_at meet nothing; host is then null or as found.  Repeated rows are each returned; empty tables give no rows or no entries.

    Only captures that meet an entry are grouped, so a hot host costs no more than its rows; the list is broadcast
    when its counted size allows.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract("url", _HOST, 1)), r"\.+$", "")
    rows = captures.select("id", "url", "fetched_at", F.when(host != "", host).alias("host"))
    first = F.regexp_extract("url", _FIRST, 1)
    listed = intervals(events)
    known = listed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("labels")).first()
    labels = F.split("host", r"\.")
    # Domains of more labels than any listed key has meet none, so a host of very many labels makes few.
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    first_of = F.least(F.greatest(F.size(labels) - F.lit(known["labels"] or 1) + 1, F.lit(1)), last)
    domains = F.transform(F.sequence(first_of, last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    with_path = F.when(first != "", F.transform("domains", lambda d: F.concat(d, F.lit("/"), F.lower(first)))).otherwise(F.array().cast("array<string>"))
    keyed = rows.filter("host is not null and fetched_at is not null").withColumn("domains", domains)
    keyed = keyed.select("id", "url", "fetched_at", F.explode(F.concat("domains", with_path)).alias("key"))
    if known["n"] <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    active = keyed.join(listed, "key").filter("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    # One capture meets one key and category once; copies of a capture meet it once each, so distinct before counting.
    met = active.select("id", "url", "fetched_at", "key", "category").distinct().groupBy("id", "url", "fetched_at").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("cats"),
        F.max(F.when(F.col("category") == TRUSTED, F.length("key")).otherwise(0)).alias("pro"),
        F.max(F.when(F.col("category") != TRUSTED, F.length("key")).otherwise(0)).alias("con"),
    )
    met = met.select(F.col("id").alias("i"), F.col("url").alias("u"), F.col("fetched_at").alias("f"), "n", "cats", F.when((F.col("pro") > 0) & (F.col("pro") >= F.col("con")), "allow").otherwise("block").alias("v"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("url") == F.col("u")) & (F.col("fetched_at") == F.col("f"))
    return rows.join(met, same, "left").select(
        "id", "url", "fetched_at", "host", F.coalesce("n", F.lit(0).cast("long")).alias("n_active"), F.coalesce("cats", F.lit("")).alias("categories"), F.coalesce("v", F.lit("none")).alias("verdict")
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.expr(_FETCHED).alias("fetched_at"))
    found = judged(pages, spark.sql(_EVENTS_SQL))
    return found.select(F.col("id").alias("page_id"), "fetched_at", "host", "n_active", "categories", "verdict")


OP4_SQL = rf"""
WITH events AS ({_EVENTS_SQL}), spans AS (
  SELECT key, category, action, since AS valid_from, lead(since) OVER (PARTITION BY key, category ORDER BY since, action) AS valid_to FROM events
), c AS (
  SELECT page_id, {_FETCHED} AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\.+$', ''), '') AS host, lower(regexp_extract(url, '{_FIRST}', 1)) AS first
  FROM pages
), k AS (
  SELECT page_id, fetched_at, first, unnest(list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i:], '.'))) AS domain
  FROM (SELECT *, string_split(host, '.') AS l FROM c WHERE host IS NOT NULL)
), keyed AS (
  SELECT page_id, fetched_at, domain AS key FROM k UNION ALL SELECT page_id, fetched_at, domain || '/' || first FROM k WHERE first <> ''
), met AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS cats,
    max(CASE WHEN category = '{TRUSTED}' THEN length(s.key) ELSE 0 END) AS pro, max(CASE WHEN category <> '{TRUSTED}' THEN length(s.key) ELSE 0 END) AS con
  FROM keyed JOIN spans s ON keyed.key = s.key AND s.action = 'add' AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
  GROUP BY page_id
)
SELECT c.page_id, c.fetched_at, c.host, coalesce(n, 0) AS n_active, coalesce(cats, '') AS categories,
  CASE WHEN n IS NULL THEN 'none' WHEN pro > 0 AND pro >= con THEN 'allow' ELSE 'block' END AS verdict
FROM c LEFT JOIN met USING (page_id)
"""
