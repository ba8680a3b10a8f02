"""Secret scans: strong patterns alone, weak ones where complementary parts of a credential stand close together.
DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweave.functions.folds import fold, places

from .common import read_table, saved, text_or_empty

#: Kinds in the order in which spans of one start are listed; the first three are found by pattern alone.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Code points between the starts of two parts of one credential.
SCOPE = 400

_NAMES = "(?:password|passwd|secret|token|api_?key)"
#: kind -> (quick test, pattern, group that has a least length, that length).  In a pattern group 1 is the match.
#: Runs shorter than asked are left out by {n,}: a run is taken whole or not at all, so that is the same.
PATTERNS = {
    "assign": (rf"(?i:{_NAMES})[\"']?\x20*[:=]", rf"((?i:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 8),
    "access": ("AKIA[A-Z0-9]{12}", "(AKIA[A-Z0-9]{12,})", 1, 16),
    "hex": ("[0-9a-f]{32}", "([0-9a-f]{32,})", 1, 32),
    "weak_id": ("ASIA[A-Z0-9]{12}", "(ASIA[A-Z0-9]{12,})", 1, 16),
    # At least forty of these signs; of just forty is a weak secret.
    "weak_secret": ("[A-Za-z0-9+/]{40}", "([A-Za-z0-9+/]{40,})", 1, 40),
    "endpoint": ("https?://[A-Za-z0-9]", r"(https?://[A-Za-z0-9][A-Za-z0-9.-]*(?::[0-9]+)?)", 1, 8),
}


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<s, k, e>> of a kind's spans in code points, leftmost and non-overlapping.

    Texts without what the kind needs stop at one quick test; of the others one pass splits the text at the matches
    and one takes them.  The group that has a least length is read from the match alone.
    """
    quick, pattern, group, least = PATTERNS[kind]

    def size(m: Column) -> Column:
        return F.length(m) if group == 1 else F.length(F.regexp_extract(m, pattern, group))

    fits = (lambda x: size(x["m"]) == least) if kind == "weak_secret" else (lambda x: size(x["m"]) >= least)
    found = F.transform(F.filter(places(text, pattern), fits), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))
    return F.when(F.regexp_like(text, F.lit(quick)), found).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


_SPAN = "struct<s:int,k:int,e:int>"


def _clear_of(spans: Column, others: Column) -> Column:
    """Those of spans (of one kind, after the others') that overlap none of others: one pass from each side."""
    mine = KINDS.index("weak_secret")

    def told(x: Column, overlaps: Column) -> Column:
        return F.when((x["k"] == mine) & ~overlaps, F.array(x)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    def from_left(end: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["k"] == mine, end).otherwise(F.greatest(end, x["e"])), told(x, end > x["s"])

    def from_right(start: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["k"] == mine, start).otherwise(F.least(start, x["s"])), told(x, start < x["e"])

    left = fold(F.array_sort(F.concat(others, spans)), F.lit(0), from_left, _SPAN)["out"]
    both = fold(F.reverse(F.array_sort(F.concat(others, left))), F.lit(2**31 - 1), from_right, _SPAN)["out"]
    return F.when(F.size(spans) > 0, F.reverse(both)).otherwise(spans)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _close_to(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows (doc_id, mark, span) with one of others starting at most SCOPE away: an interval join by buckets of the
    starts.  A semi-join, so a crowd of parts in one place makes no pairs."""
    cell = F.floor(F.col("span.s") / SCOPE)
    near = others.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("span.s").alias("at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("c"))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (cell == F.col("c")) & (F.abs(F.col("span.s") - F.col("at")) <= SCOPE)
    return rows.join(near, on, "left_semi")


def _count_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans.

    base_sha256 is of the spans of the first three kinds.  Of the weak kinds a span counts only in company, within
    SCOPE code points: a weak identifier near a secret (strong or weak), a weak secret near an identifier, an endpoint
    near both.  A weak secret inside a strong span is that one's own text.  Null text counts as empty; repeated rows
    are each returned; an empty table gives no rows.
    """
    text = text_or_empty()
    scanned = docs.select("doc_id", F.xxhash64(text).alias("mark"), *[spans_of(text, k).alias(k) for k in KINDS])
    base = F.concat("assign", "access", "hex")
    own = _clear_of(F.col("weak_secret"), base)
    scanned = scanned.select("doc_id", "mark", base.alias("base"), F.concat("weak_id", own, "endpoint").alias("weak"))
    scanned = saved(scanned, "secrets")
    parts = scanned.filter(F.size("weak") > 0).select("doc_id", "mark", F.explode(F.concat("base", "weak")).alias("span")).distinct()
    kind = F.col("span.k")
    ids, secrets = parts.filter(kind.isin(1, 3)), parts.filter(kind.isin(0, 2, 4))
    linked = _close_to(parts.filter(kind == 3), secrets).unionByName(_close_to(parts.filter(kind == 4), ids))
    linked = linked.unionByName(_close_to(_close_to(parts.filter(kind == 5), ids), secrets))
    linked = linked.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.collect_list("span").alias("linked"))
    full = scanned.join(linked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    extra = F.coalesce("linked", F.array().cast("array<struct<s:int,k:int,e:int>>"))
    counts = [_count_of(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:3])]
    return full.select("doc_id", *counts, F.size(extra).cast("long").alias("n_linked"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", extra)).alias("spans"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read_table(spark, sf_dir, "documents"))


def _found_sql(kind: str) -> str:
    _, pattern, group, least = PATTERNS[kind]
    pattern = pattern.replace("'", "''")
    texts = [f"regexp_extract_all(t, '(?s)(.*?){pattern}', {g})" for g in (1, 2, group + 1)]
    fits = f"length(v[i]) {'=' if kind == 'weak_secret' else '>='} {least}"
    at = "CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"""SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS k, {at} AS s, {at} + length(m[i]) AS e
  FROM (SELECT doc_id, b, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, {texts[0]} AS b, {texts[1]} AS m, {texts[2]} AS v FROM d)) WHERE {fits}"""


def _near_sql(a: str, kinds: str) -> str:
    return f"EXISTS (SELECT 1 FROM p o WHERE o.doc_id = {a}.doc_id AND o.k IN ({kinds}) AND abs(o.s - {a}.s) <= {SCOPE})"


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (
{" UNION ALL ".join(map(_found_sql, KINDS))}
), p AS (
  SELECT * FROM f WHERE NOT (k = 4 AND EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.k < 3 AND o.s < f.e AND f.s < o.e))
), c AS (
  SELECT *, k < 3 OR (k = 3 AND {_near_sql("p", "0, 2, 4")}) OR (k = 4 AND {_near_sql("p", "1, 3")}) OR (k = 5 AND {_near_sql("p", "1, 3")} AND {_near_sql("p", "0, 2, 4")}) AS shown FROM p
), g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k > 2) AS n_linked,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM c WHERE shown GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_linked, 0) AS n_linked,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
