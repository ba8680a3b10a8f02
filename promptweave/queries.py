"""Registered queries over the `entries` view, and their SQL twins.

Order is a column (rn, seq, nth) where it matters; lists are joined to strings; long texts are returned as their MD5.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweave import oracle as O
from promptweave.functions import blocks as B
from promptweave.functions import patterns as P
from promptweave.functions import tags as G
from promptweave.functions import text as T
from promptweave.operators import boundaries as D
from promptweave.operators import entries as E
from promptweave.plans import lineage, listing, pipeline, prompt, reports, validate
from promptweave.sources import artifacts, books
from promptweave.tables import hadoop, shared_folder, written
from promptweave.views import entries_view, flawed_view, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}



def query(sql: str | None, ctes: str = O.ENTRIES):
    """Register a query, with SQL after WITH ctes if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return register


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.complete(entries_view(spark, sf_dir))


def with_full(ctes: str) -> str:
    return f"{O.ENTRIES}, {O.FULL}, {ctes}"


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.complete(flawed_view(spark, sf_dir))


def with_flawed(ctes: str) -> str:
    return f"{O.FLAWED}, {ctes}"


def shown(entries: DataFrame) -> DataFrame:
    keys = ["book_id", "seq", "uid", "ord", "position", "depth", "constant", "disable"]
    rest = ["role", "probability", "use_probability", "sticky", "cooldown", "delay", "comment"]
    return entries.select(*keys, F.array_join("key", ",").alias("keys"), *rest, F.md5(F.col("content")).alias("content_md5"))


# Text functions


@query(f"SELECT book_id, {O.label()} AS label, count(*) AS n FROM entries GROUP BY ALL")
def type_histogram(spark, sf_dir):
    return E.label_counts(entries_view(spark, sf_dir))


_NAMED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, {O.q(p)}) THEN {O.q(n)} END" for n, p in P.MARKERS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT book_id, seq, array_to_string({_NAMED}, '|') AS markers FROM entries")
def markers(spark, sf_dir):
    return entries_view(spark, sf_dir).select("book_id", "seq", F.array_join(T.markers(F.col("content")), "|").alias("markers"))


@query(f"SELECT marker, count(*) AS n FROM (SELECT unnest({_NAMED}) AS marker FROM entries) GROUP BY marker")
def marker_counts(spark, sf_dir):
    return entries_view(spark, sf_dir).select(F.explode(T.markers(F.col("content"))).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT book_id, seq, {O.static('content')} AS is_static FROM entries")
def static_flag(spark, sf_dir):
    return entries_view(spark, sf_dir).select("book_id", "seq", T.is_static(F.col("content")).alias("is_static"))


@query(f"SELECT book_id, seq, {O.plugin('content', 'comment')} AS has_plugin FROM entries")
def plugin_flag(spark, sf_dir):
    return entries_view(spark, sf_dir).select("book_id", "seq", T.has_plugin(F.col("content"), F.col("comment")).alias("has_plugin"))


@query(rf"""SELECT book_id, seq, md5(regexp_replace(content, '(?s)<%[-_=#]?.*?%>', '', 'g')) AS no_code, md5(regexp_replace(content, '\{{\{{.*?\}}\}}', '', 'g')) AS no_macros,
  md5({O.residue("content")}) AS residue, md5({O.strip("content")}) AS stripped FROM entries""")
def strip_residue(spark, sf_dir):
    parts = {"no_code": T.without_code(F.col("content")), "no_macros": T.without_macros(F.col("content")), "residue": T.residue(F.col("content")), "stripped": T.strip(F.col("content"))}
    return entries_view(spark, sf_dir).select("book_id", "seq", *[F.md5(v).alias(k) for k, v in parts.items()])


@query(f"SELECT book_id, seq, md5(regexp_replace(content, {O.q(P.CODE_LITERALS)}, ' ', 'g')) AS bare, {O.braces('content')} AS net FROM entries")
def net_braces(spark, sf_dir):
    return entries_view(spark, sf_dir).select("book_id", "seq", F.md5(T.without_literals(F.col("content"))).alias("bare"), T.net_braces(F.col("content")).cast("bigint").alias("net"))


@query("SELECT book_id, seq, b.kind AS type, b.s AS start_line, b.e AS end_line, CAST(b.d AS INT) AS brace_delta, md5(b.body) AS body_md5 FROM (SELECT book_id, seq, unnest(bl) AS b FROM blk)", f"{O.ENTRIES}, {O.blocks_cte('entries')}")
def code_blocks(spark, sf_dir):
    rows = entries_view(spark, sf_dir).select("book_id", "seq", F.explode(B.blocks_of(F.col("content"))).alias("b"))
    return rows.select("book_id", "seq", "b.type", "b.start_line", "b.end_line", "b.brace_delta", F.md5("b.content").alias("body_md5"))


@query("SELECT book_id, seq, r.s AS s, r.e AS e FROM (SELECT book_id, seq, unnest(rg) AS r FROM rng)", f"{O.ENTRIES}, {O.blocks_cte('entries')}, {O.ranges_cte()}")
def compound_ranges(spark, sf_dir):
    rows = entries_view(spark, sf_dir)
    return rows.select("book_id", "seq", F.explode(B.compound_ranges(B.blocks_of(F.col("content")), F.size(T.lines_of(F.col("content"))))).alias("r")).select("book_id", "seq", "r.s", "r.e")


@query("SELECT book_id, seq, net <> 0 AS unclosed FROM rng", f"{O.ENTRIES}, {O.blocks_cte('entries')}, {O.ranges_cte()}")
def unclosed_code(spark, sf_dir):
    return entries_view(spark, sf_dir).select("book_id", "seq", (B.code_balance(F.col("content")) != 0).alias("unclosed"))


@query("SELECT book_id, seq, st AS is_static, mixed0 AS is_mixed FROM cls", f"{O.ENTRIES}, {O.blocks_cte('entries')}, {O.ranges_cte()}, {O.classes_cte()}")
def classify(spark, sf_dir):
    lines = F.size(T.lines_of(F.col("content")))
    # Texts without code have no blocks to fold.
    found = F.when(F.contains("content", F.lit("<%")), B.compound_ranges(B.blocks_of(F.col("content")), lines)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    static, mixed = B.classified(F.col("content"), F.col("found"), lines)
    return entries_view(spark, sf_dir).withColumn("found", found).select("book_id", "seq", static.alias("is_static"), mixed.alias("is_mixed"))


_PAGES = "p AS (SELECT page_id, html AS content FROM pages)"


@query("SELECT page_id, tag, CAST(a AS INT) AS open_start, CAST(z AS INT) AS close_end FROM tag_pairs", f"{_PAGES}, {O.tags_cte('p', 'page_id')}")
def xml_tag_spans(spark, sf_dir):
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", F.col("html").alias("content"))
    return pages.select("page_id", F.explode(G.tag_spans(F.col("content"))).alias("t")).select("page_id", "t.*")


@query("SELECT page_id, arg_max(tag, struct_pack(size := z - a, last := -z)) AS tag FROM tag_pairs GROUP BY page_id", f"{_PAGES}, {O.tags_cte('p', 'page_id')}")
def outermost_tag(spark, sf_dir):
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", F.col("html").alias("content"))
    return pages.select("page_id", G.outermost(G.tag_spans(F.col("content"))).alias("tag")).filter("tag is not null")


_H = O.q(P.HEADING)
_SEGMENTS = f"""s0 AS (SELECT book_id, seq, {O.lines("content")} AS ls FROM entries), s1 AS (SELECT book_id, seq, unnest(range(0, len(ls))) AS i, unnest(ls) AS l FROM s0), s2 AS (
  SELECT *, sum(CASE WHEN regexp_matches(l, {_H}) OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, seq ORDER BY i) AS part FROM s1
)"""


@query(f"""SELECT book_id, seq, CAST(min(i) AS INT) AS start_line, CAST(max(i) AS INT) AS end_line,
  CAST(CASE WHEN regexp_matches(arg_min(l, i), {_H}) THEN length(regexp_extract(arg_min(l, i), {_H}, 1)) END AS INT) AS level,
  CASE WHEN regexp_matches(arg_min(l, i), {_H}) THEN {O.strip(f"regexp_extract(arg_min(l, i), {_H}, 2)")} ELSE '' END AS heading FROM s2 GROUP BY book_id, seq, part""", f"{O.ENTRIES}, {_SEGMENTS}")
def heading_segments(spark, sf_dir):
    rows = entries_view(spark, sf_dir).select("book_id", "seq", F.explode(G.heading_segments(T.lines_of(F.col("content")))).alias("s"))
    return rows.select("book_id", "seq", "s.start_line", "s.end_line", "s.level", "s.heading")


@query(f"SELECT book_id, seq, {O.bare('content')} AS bare, md5({O.no_tag_lines('content')}) AS no_tag_lines FROM entries")
def bare_segments(spark, sf_dir):
    return entries_view(spark, sf_dir).select("book_id", "seq", T.is_bare(F.col("content")).alias("bare"), F.md5(T.without_tag_lines(F.col("content"))).alias("no_tag_lines"))


@query(f"SELECT book_id, seq, b.kind AS kind, b.name AS name, b.copy AS copy, {O.static('content')} AS is_static, {O.is_copy_content('content')} AS copy_content FROM (SELECT *, {O.boundary('content')} AS b FROM entries)")
def boundary_detect(spark, sf_dir):
    rows = entries_view(spark, sf_dir).withColumn("b", T.boundary(F.col("content")))
    return rows.select("book_id", "seq", "b.kind", "b.name", "b.copy", T.is_static(F.col("content")).alias("is_static"), T.is_copy_content(F.col("content")).alias("copy_content"))


_SUFFIXED = "CASE seq % 5 WHEN 0 THEN comment || ' [split-static]' WHEN 1 THEN comment || ' [boundary-copy-open] [split-dynamic]' WHEN 2 THEN '合并:1-2' WHEN 3 THEN '[supplement-start]' ELSE comment END"


@query(rf"""SELECT book_id, seq, {O.strip(rf"regexp_replace(c, '{P.WS}*\[(split-static|split-dynamic|boundary-copy-open|boundary-copy-close)\]$', '')")} AS base,
  contains(c, '[split-static]') AS split_static, contains(c, '[split-dynamic]') AS split_dynamic, starts_with(c, '合并:') AS merged, contains(c, '[boundary-copy-') AS copy, contains(c, '[supplement-') AS supplement,
  left(c, 40) || ' (uid=' || uid || ' order=' || ord || ' pos=' || position || ')' AS short FROM (SELECT *, {_SUFFIXED} AS c FROM entries)""")
def comment_marks(spark, sf_dir):
    c = F.expr(_SUFFIXED)
    tests = {"base": T.comment_base, "split_static": T.is_split_static, "split_dynamic": T.is_split_dynamic, "merged": T.is_merged, "copy": T.is_copy, "supplement": T.is_supplement}
    short = T.short_label(c, F.col("uid"), F.col("ord"), F.col("position"))
    return entries_view(spark, sf_dir).select("book_id", "seq", *[f(c).alias(k) for k, f in tests.items()], short.alias("short"))


# The four steps


@query("""SELECT book_id, seq, st AS is_static, mixed AS is_mixed, seg_ok.seq IS NOT NULL AS suggested_split,
  coalesce(array_to_string(list_transform(rg, lambda r: r.s || '-' || r.e), ','), '') AS ranges FROM ana0 LEFT JOIN seg_ok USING (book_id, seq)""", with_full(O.analysis_ctes()))
def analysis(spark, sf_dir):
    rows = pipeline.analyze(entries_view(spark, sf_dir))
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string"))), ",")
    return rows.select("book_id", "seq", "is_static", "is_mixed", "suggested_split", ranges.alias("ranges"))


@query("SELECT book_id, count(*) AS total, count(*) FILTER (st) AS n_static, count(*) FILTER (NOT st AND NOT mixed) AS n_dynamic, count(*) FILTER (mixed) AS n_mixed FROM ana0 GROUP BY book_id", with_full(O.analysis_ctes()))
def tri_state_summary(spark, sf_dir):
    return pipeline.analysis_summary(pipeline.analyze(entries_view(spark, sf_dir)))


@query("SELECT book_id, seq, CAST(level AS INT) AS level, heading, CAST(s1 AS INT) AS start_line, CAST(e1 AS INT) AS end_line, dyn AS is_dynamic, wrap_tag FROM seg SEMI JOIN seg_ok USING (book_id, seq)", with_full(O.analysis_ctes()))
def split_boundaries(spark, sf_dir):
    rows = pipeline.analyze(entries_view(spark, sf_dir))
    return rows.select("book_id", "seq", F.explode_outer("boundaries").alias("b")).filter("b is not null").select("book_id", "seq", "b.*")


@query(f"SELECT {O.SHOWN} FROM split_out", with_full(O.split_ctes()))
def split_entries(spark, sf_dir):
    return shown(pipeline.split(entries_view(spark, sf_dir)))


@query(f"SELECT {O.SHOWN} FROM split_out", with_full(O.split_ctes()))
def split_with_analysis(spark, sf_dir):
    rows = entries_view(spark, sf_dir)
    return shown(pipeline.split(rows, pipeline.analyze(rows).select("book_id", "uid", "seq", *pipeline.ANALYSIS)))


@query("SELECT * FROM pr", with_full(O.pairs_ctes("full_entries")))
def boundary_pairs(spark, sf_dir):
    return D.boundary_pairs(full(spark, sf_dir))


@query("SELECT book_id, seq, pair_no, side, ord, position, comment, content FROM cps", with_full(O.reorder_ctes("full_entries")))
def boundary_copies(spark, sf_dir):
    copies = D.boundary_copies(full(spark, sf_dir))
    return copies.select("book_id", "seq", F.col("_pair").alias("pair_no"), F.col("_side").alias("side"), "ord", "position", "comment", "content")


@query("SELECT book_id, n_tags, n_headings, has_dynamic, has_wrapper, style FROM style", with_full(O.style_cte("full_entries")))
def wrapper_style(spark, sf_dir):
    return D.wrapper_style(full(spark, sf_dir))


@query("SELECT book_id, content, comment, side FROM supp", with_full(f"{O.style_cte('full_entries')}, {O.supplements_cte()}"))
def supplements(spark, sf_dir):
    return D.supplements(full(spark, sf_dir))


_SORTED = f"srt AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY {O.SORT_KEYS}, seq) - 1 AS rn FROM (SELECT *, {O.static('content')} AS st, false AS cp, false AS sp FROM full_entries))"


@query("SELECT book_id, seq, rn FROM srt", with_full(_SORTED))
def sort6(spark, sf_dir):
    return E.plain_sort(full(spark, sf_dir)).select("book_id", "seq", "rn")


@query(f"SELECT book_id, seq, array_to_string(key, ',') AS keys, * EXCLUDE (book_id, seq, key) FROM (SELECT book_id, seq, {O.rules('(seq % 7 = 3)', 'st')} FROM (SELECT *, {O.static('content')} AS st FROM full_entries))", with_full("one AS (SELECT 1)"))
def field_rules(spark, sf_dir):
    rows = full(spark, sf_dir)
    rules = D.field_rules(T.is_static(F.col("content")), F.col("seq") % 7 == 3)
    return rows.select("book_id", "seq", *[v.alias(k) for k, v in rules.items()]).withColumn("keys", F.array_join("key", ",")).drop("key")


@query(f"SELECT {O.SHOWN} FROM re_out", with_full(O.reorder_ctes("full_entries")))
def reorder_full(spark, sf_dir):
    return shown(pipeline.reorder(entries_view(spark, sf_dir)))


_ONE_BOOK = "one_book AS (SELECT * REPLACE (CAST(0 AS BIGINT) AS book_id, uid * 8 + book_id AS seq, uid * 8 + book_id AS uid) FROM full_entries)"


@query(f"SELECT {O.SHOWN} FROM re_out", with_full(f"{_ONE_BOOK}, {O.reorder_ctes('one_book')}"))
def reorder_one_book(spark, sf_dir):
    """All entries as one book, ordered by ranges over all tasks."""
    at = F.col("uid") * 8 + F.col("book_id")
    rows = entries_view(spark, sf_dir).withColumns({"seq": at, "uid": at, "book_id": F.lit(0).cast("bigint")})
    return shown(pipeline.reorder(rows, ranges=True))


@query(f"SELECT {O.SHOWN} FROM me_out", with_full(O.merge_ctes("full_entries")))
def merge_static(spark, sf_dir):
    return shown(pipeline.merge(entries_view(spark, sf_dir)))


@query(f"SELECT {O.SHOWN} FROM me_out", O.PIPELINE)
def pipeline_full(spark, sf_dir):
    return shown(pipeline.pipeline(entries_view(spark, sf_dir)))


# Listings

_NONE = "coalesce(CAST({} AS VARCHAR), 'None')"


def _listed(where: str = "true") -> str:
    """lst: the sorted listing."""
    hidden = f"contains(comment, '{P.COPY}') OR contains(comment, '{P.SUPPLEMENT}') OR key = ['{P.ALWAYS_KEY}']"
    return f"lst AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY {O.SORT_KEYS}, seq) - 1 AS rn FROM (SELECT *, {O.static('content')} AND NOT ({hidden}) AS st, false AS cp, false AS sp FROM full_entries) WHERE {where})"


@query("SELECT book_id, rn, ord, position, depth, st AS static, constant, uid, comment FROM lst", with_full(_listed("st")))
def list_static(spark, sf_dir):
    return listing.listing(entries_view(spark, sf_dir), True).drop("content", "key")


@query(f"SELECT book_id, rn, concat_ws(',', ord, position, {_NONE.format('depth')}, {O.mark('st')}, {O.mark('constant')}, uid, comment) AS line FROM lst", with_full(_listed()))
def list_csv(spark, sf_dir):
    return listing.listing_csv(listing.listing(entries_view(spark, sf_dir)))


@query(f"SELECT book_id, rn, printf('%5s  %3s  %5s  %6s  %6s  %4s  %s', CAST(ord AS VARCHAR), CAST(position AS VARCHAR), {_NONE.format('depth')}, 'x', 'x', CAST(uid AS VARCHAR), comment) AS line FROM lst", with_full(_listed("NOT st")))
def list_table(spark, sf_dir):
    rows = listing.listing_table(listing.listing(entries_view(spark, sf_dir), False))
    return rows.withColumn("line", F.translate("line", "✓✗", "xx"))


@query("SELECT book_id, count(*) AS total, count(*) FILTER (st) AS n_static, count(*) FILTER (NOT st) AS n_dynamic FROM lst GROUP BY book_id", with_full(_listed()))
def list_summary(spark, sf_dir):
    return listing.listing_summary(listing.listing(entries_view(spark, sf_dir)))


_PREVIEW = """SELECT book_id, rn, uid, '--' AS keys, CASE WHEN length(content) <= 500 THEN 'Content (' || length(content) || ' chars):' ELSE 'Content preview (500/' || length(content) || ' chars):' END AS label,
  CASE WHEN length(content) <= 500 THEN content ELSE left(content, 500) || '...(truncated)' END AS preview FROM lst"""


@query(_PREVIEW, with_full(_listed("contains(lower(comment), 'src1-') OR contains(lower(content), 'src1-')")))
def list_full_search(spark, sf_dir):
    return listing.full_listing(entries_view(spark, sf_dir), search="SRC1-").select("book_id", "rn", "uid", "keys", "label", "preview")


@query(_PREVIEW, with_full(_listed("uid = 7 AND st")))
def list_full_uid(spark, sf_dir):
    return listing.full_listing(entries_view(spark, sf_dir), static=True, uid=7).select("book_id", "rn", "uid", "keys", "label", "preview")


def _found(where: str) -> str:
    return f"qry AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord, seq) - 1 AS rn FROM (SELECT *, {O.label()} AS label FROM full_entries) WHERE {where})"


_FOUND = "SELECT book_id, rn, ord, position, depth, label, constant, disable, uid, comment FROM qry"


@query(_FOUND, with_full(_found("label = 'dynamic'")))
def query_label(spark, sf_dir):
    return listing.query(entries_view(spark, sf_dir), label="dynamic")


@query(_FOUND, with_full(_found("ord BETWEEN 100 AND 300")))
def order_range(spark, sf_dir):
    return listing.query(entries_view(spark, sf_dir), order_range=(100, 300))


@query(_FOUND, with_full(_found("contains(comment, 'The ') OR contains(content, 'The ')")))
def search_cs(spark, sf_dir):
    return listing.query(entries_view(spark, sf_dir), search="The ")


@query(f"SELECT book_id, rn, concat_ws(',', ord, position, {_NONE.format('depth')}, label, {O.mark('constant')}, {O.mark('disable')}, uid, comment) AS line FROM qry", with_full(_found("true")))
def query_csv(spark, sf_dir):
    return listing.query_csv(listing.query(entries_view(spark, sf_dir)))


@query(f"SELECT book_id, rn, printf('%4s  %5s  %3s  %5s  %10s  %6s  %4s  %4s  %s', CAST(rn AS VARCHAR), CAST(ord AS VARCHAR), CAST(position AS VARCHAR), {_NONE.format('depth')}, label, 'x', 'x', CAST(uid AS VARCHAR), comment) AS line FROM qry", with_full(_found("true")))
def query_table(spark, sf_dir):
    return listing.query_table(listing.query(entries_view(spark, sf_dir))).withColumn("line", F.translate("line", "✓✗", "xx"))


_TOTAL_LINE = """SELECT book_id, 9 AS part, CAST(1 AS BIGINT) AS rn, 'Total: ' || sum(n) || ' entries (' || string_agg(label || '=' || n, ', ' ORDER BY label) || ')' AS line FROM (SELECT book_id, label, count(*) AS n FROM qry GROUP BY ALL) GROUP BY book_id"""
_HEADS = f"""SELECT book_id, 0 AS part, CAST(0 AS BIGINT) AS rn, {O.q(reports.QUERY_TABLE)} AS line FROM books UNION ALL SELECT book_id, 0, 1, repeat('─', 100) FROM books UNION ALL SELECT book_id, 9, 0, repeat('─', 100) FROM books"""


@query(f"""{_HEADS} UNION ALL {_TOTAL_LINE}
  UNION ALL SELECT book_id, 1, rn, printf('%4s  %5s  %3s  %5s  %10s  %6s  %4s  %4s  %s', CAST(rn AS VARCHAR), CAST(ord AS VARCHAR), CAST(position AS VARCHAR), {_NONE.format('depth')}, label, 'x', 'x', CAST(uid AS VARCHAR), comment) FROM qry""",
       with_full(_found("ord BETWEEN 100 AND 300") + ", books AS (SELECT DISTINCT book_id FROM full_entries)"))
def query_report(spark, sf_dir):
    """A query's whole report: head, entries, totals."""
    return reports.query_report(entries_view(spark, sf_dir), order_range=(100, 300)).withColumn("line", F.translate("line", "✓✗", "xx"))


_KINDS = ", ".join(f"count(*) FILTER (label = '{k}') AS n_{k}" for k in ("static", "dynamic", "boundary", "supplement", "merged"))
_SUMMARY = f"""SELECT book_id, count(*) AS total, {_KINDS}, min(ord) AS min_ord, max(ord) AS max_ord, min(ord) = 0 AND max(ord) = count(*) - 1 AND count(DISTINCT ord) = count(*) AS ord_continuous,
  min(uid) AS min_uid, max(uid) AS max_uid, min(uid) = 0 AND max(uid) = count(*) - 1 AND count(DISTINCT uid) = count(*) AS uid_continuous FROM (SELECT *, {O.label()} AS label FROM {{}}) GROUP BY book_id"""


@query(_SUMMARY.replace("{}", "full_entries"), with_full("one AS (SELECT 1)"))
def query_summary(spark, sf_dir):
    return E.summary(full(spark, sf_dir))


@query(_SUMMARY.replace("{}", "me_out"), O.PIPELINE)
def result_summary(spark, sf_dir):
    return E.summary(pipeline.pipeline(entries_view(spark, sf_dir)))


@query(f"""SELECT book_id, static_max, dynamic_min, NOT (static_max >= 0 AND dynamic_min < n AND static_max > dynamic_min) AS static_first FROM (
  SELECT book_id, coalesce(max(ord) FILTER (NOT moving), -1) AS static_max, coalesce(min(ord) FILTER (moving), count(*)) AS dynamic_min, count(*) AS n
  FROM (SELECT *, {O.label()} IN ('boundary', 'supplement', 'dynamic') AS moving FROM full_entries) GROUP BY book_id)""", with_full("one AS (SELECT 1)"))
def static_frontier(spark, sf_dir):
    return E.frontier(full(spark, sf_dir))


# Prompts

_RANK = "CASE position " + " ".join(f"WHEN {p} THEN {r}" for p, r in prompt.RANKS.items()) + " END"
_SECTIONS = f"""{_SORTED}, chat AS (SELECT conv_id AS book_id, turn, role, text FROM conversations), books AS (SELECT DISTINCT book_id FROM full_entries), talks AS (SELECT book_id, count(*) AS n FROM chat GROUP BY book_id), sec AS (
  SELECT book_id, {_RANK} AS section, CAST(CASE WHEN position = 4 THEN -depth ELSE 0 END AS BIGINT) AS part_group, rn AS part_rn, content AS text FROM srt LEFT JOIN talks USING (book_id)
  WHERE position <> 7 AND (position <> 4 OR (depth >= 0 AND coalesce(n, 0) > 0))
  UNION ALL SELECT book_id, s.k, 0, 0, s.t FROM books, (VALUES (1, '[System Prompt Placeholder]'), (3, '[Persona Description Placeholder]'), (4, '[Character Description Placeholder]'), (5, '[Character Personality Placeholder]'), (6, 'a scene')) AS s(k, t)
  UNION ALL SELECT book_id, 11, 0, turn, CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '角色' WHEN 'system' THEN '系统' ELSE role END || ': ' || text FROM chat SEMI JOIN books USING (book_id)
)"""


def _sections(spark, sf_dir) -> DataFrame:
    rows = entries_view(spark, sf_dir)
    chat = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("book_id"), "turn", "role", "text")
    chat = chat.join(rows.select("book_id").distinct(), "book_id", "left_semi")
    return prompt.sections(rows, chat=chat, scenario=" a scene ")


@query("SELECT book_id, section, part_group, part_rn, md5(text) AS text_md5 FROM sec", with_full(_SECTIONS))
def prompt_sections(spark, sf_dir):
    return _sections(spark, sf_dir).select("book_id", "section", "part_group", "part_rn", F.md5("text").alias("text_md5"))


@query("SELECT book_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_md5 FROM (SELECT book_id, string_agg(text, chr(10) ORDER BY section, part_group, part_rn) AS t FROM sec GROUP BY book_id)", with_full(_SECTIONS))
def prompt_text(spark, sf_dir):
    return prompt.prompt_text(_sections(spark, sf_dir)).select("book_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _bar(title: str) -> str:
    return O.q(f"<!-- ============ {title} ============ -->")


_HELD = {2: ("[2/12] World Info (before) pos=0", "2"), 7: ("[7/12] World Info (after) pos=1", "7"), 8: ("[8/12] Chat Examples pos=5 [top]", "8"), 12: ("[10/12] Author''s Note pos=2/3", "12, 13")}
_ALWAYS = {3: "[3/12] Persona Description", 4: "[4/12] Character Description", 5: "[5/12] Character Personality", 6: "[6/12] Scenario"}
_TITLED = " UNION ALL ".join(
    [f"SELECT DISTINCT book_id, {k}, 0, 0, 0, 0, chr(10) || '<!-- ============ {t} ============ -->' FROM plc WHERE section IN ({w})" for k, (t, w) in _HELD.items()]
    + [f"SELECT book_id, {k}, 0, 0, 0, 0, chr(10) || {_bar(t)} FROM books" for k, t in _ALWAYS.items()]
    + [f"SELECT book_id, 1, 0, 0, 0, 0, {_bar('[1/12] System Prompt')} FROM books", f"SELECT book_id, 10, 0, -1, 0, 0, chr(10) || {_bar('[9/12] Chat History (with pos=4 atDepth)')} FROM books"]
    + ["SELECT DISTINCT book_id, 9, 0, 0, 0, 0, chr(10) || '<!-- Chat Examples pos=6 [bottom] -->' FROM plc WHERE section = 9"]
)
_FIRST = "CASE WHEN section = 10 THEN -depth ELSE 0 END"
_COMMENTED = f"""{_SORTED}, books AS (SELECT DISTINCT book_id FROM full_entries), plc AS (
  SELECT *, {_RANK} AS section FROM srt WHERE position <> 7 AND (position <> 4 OR depth >= 0)
), sec(book_id, section, g, k, rn, l, text) AS (
  SELECT book_id, section, {_FIRST}, 1, rn, 1, content FROM plc
  UNION ALL SELECT book_id, section, {_FIRST}, 1, rn, 0, '<!-- Entry uid=' || uid || ': order=' || ord || ' "' || comment || '" static=' || {O.mark("st")} || ' pos=' || position || ' depth=' || {_NONE.format("depth")} || ' -->' FROM plc
  UNION ALL SELECT book_id, section, {_FIRST}, 0, rn, 0, '<!--   injected: Entry uid=' || uid || ' order=' || ord || ' comment="' || comment || '" pos=4 depth=' || depth || ' -->' FROM plc WHERE section = 10
  UNION ALL SELECT book_id, s.k, 0, 1, 0, 0, s.t FROM books, (VALUES (1, '[System Prompt Placeholder]'), (3, '[Persona Description Placeholder]'), (4, '[Character Description Placeholder]'), (5, '[Character Personality Placeholder]'),
    (6, '[Scenario Placeholder]')) AS s(k, t)
  UNION ALL SELECT book_id, 11, 0, 1, 0, 0, chr(10) || '<!-- Chat Message 1: -->' FROM books UNION ALL SELECT book_id, 11, 0, 1, 0, 1, '用户: [Chat History Placeholder]' FROM books
  UNION ALL {_TITLED}
  UNION ALL SELECT book_id, 14, 0, 1, 0, 0, chr(10) || '<!-- ============================================ -->' || chr(10) || '<!-- 总计: 12 段, ' || (SELECT count(*) FROM plc WHERE plc.book_id = books.book_id AND section = 10) || ' 个 WI 条目注入 -->' FROM books
)"""


@query("SELECT book_id, string_agg(text, chr(10) ORDER BY section, g, k, rn, l) AS text FROM sec GROUP BY book_id", with_full(_COMMENTED))
def prompt_with_comments(spark, sf_dir):
    return prompt.prompt_text(prompt.sections(entries_view(spark, sf_dir), comments=True))


# Validation

_TEXTS = f"""{_SORTED}, books AS (SELECT DISTINCT book_id FROM full_entries), sec AS (
  SELECT book_id, {_RANK} AS section, CAST(CASE WHEN position = 4 THEN -depth ELSE 0 END AS BIGINT) AS part_group, rn AS part_rn, content AS text FROM srt WHERE position <> 7 AND (position <> 4 OR depth >= 0)
  UNION ALL SELECT book_id, s.k, 0, 0, s.t FROM books, (VALUES (1, '[System Prompt Placeholder]'), (3, '[Persona Description Placeholder]'), (4, '[Character Description Placeholder]'), (5, '[Character Personality Placeholder]'),
    (6, '[Scenario Placeholder]'), (11, '用户: [Chat History Placeholder]')) AS s(k, t)
), txt AS (SELECT book_id, string_agg(text, chr(10) ORDER BY section, part_group, part_rn) AS content FROM sec GROUP BY book_id)"""


def _finding(code: str, uid: str, message: str, source: str, level: str = "warning", scope: str = "entry") -> str:
    return f"SELECT book_id, '{code}' AS code, '{level}' AS level, '{scope}' AS scope, CAST({uid} AS BIGINT) AS uid, {message} AS message FROM {source}"


_NOT = ", ".join(O.q(x) for x in P.NOT_TAGS)
_TAG = rf"'\A<({P.NAME}+)>\z'"
_EDGE_LINES = f"(SELECT *, regexp_extract({O.strip('ls[1]')}, {_TAG}, 1) AS t1, regexp_extract({O.strip('ls[-1]')}, {_TAG}, 1) AS t2 FROM (SELECT *, {O.lines('content')} AS ls FROM full_entries) WHERE len(ls) >= 2)"
_ST = O.static("content")
ENTRY_SQL = {
    "D1": _finding("D1", "uid", "'content only contains heading/tag, no body text'", f"full_entries WHERE {O.bare('content')} AND {O.strip('content')} <> ''"),
    "F1": _finding("F1", "uid", "'constant=true but key is not empty'", "full_entries WHERE constant AND len(key) > 0"),
    "F2": _finding("F2", "uid", "'static entry with probability < 100'", f"full_entries WHERE use_probability AND probability < 100 AND {_ST}"),
    "F3": _finding("F3", "uid", "'dynamic entry with position=' || position || ' (expected 4)'", f"full_entries WHERE position <> 4 AND NOT ({_ST})"),
    "F4": _finding("F4", "uid", "'depth>=10 but position=' || position || ' (depth only meaningful at pos=4)'", "full_entries WHERE depth >= 10 AND position <> 4"),
    "F5": _finding("F5", "uid", "'content is empty'", f"full_entries WHERE {O.strip('content')} = ''"),
    "F7": _finding("F7", "uid", "'static entry contains {{time}} macro (time-varying)'", f"full_entries WHERE {_ST} AND contains(content, '{{{{time}}}}')"),
    "F8": _finding("F8", "uid", "'possible self-closing tag <' || t1 || '> at both start and end, should use <' || t1 || '>...</' || t1 || '>'", f"{_EDGE_LINES} WHERE t1 <> '' AND t1 = t2 AND t1 NOT IN ({_NOT})"),
}


def _entry_rule(code: str) -> None:
    def run(spark, sf_dir):
        return validate.entry_findings(flawed(spark, sf_dir), [code])

    run.__name__ = f"val_{code.lower()}"
    query(ENTRY_SQL[code], with_flawed("one AS (SELECT 1)"))(run)


for _code in ENTRY_SQL:
    _entry_rule(_code)

_F6 = _finding("F6", "uid", f"'order=' || ord || ' duplicate with uid=' || f || ' in group (pos=' || position || ', depth=' || {_NONE.format('depth')} || ')'",
               "(SELECT *, first_value(uid) OVER w AS f, row_number() OVER w AS n FROM full_entries WINDOW w AS (PARTITION BY book_id, position, depth, ord ORDER BY seq)) WHERE n > 1")


@query(_F6, with_flawed("one AS (SELECT 1)"))
def val_f6(spark, sf_dir):
    return validate.f6(flawed(spark, sf_dir))


_SHAPE = O.q(r"\A" + P.MD_BOUNDARY[1:])
_MD = f"md AS (SELECT book_id, seq, uid, {O.strip(f'regexp_extract(t, {_SHAPE}, 2)')} AS base, regexp_extract(t, {_SHAPE}, 3) IN ('开始', 'start', 'begin') AS o FROM (SELECT *, {O.strip('content')} AS t FROM full_entries) WHERE regexp_matches(t, {_SHAPE}))"
_D2 = " UNION ALL ".join([
    _finding("D2", "arg_max(uid, seq)", "'MD boundary #' || base || '开始 has no matching end'", "md x WHERE o AND NOT EXISTS (SELECT 1 FROM md y WHERE NOT y.o AND y.book_id = x.book_id AND y.base = x.base) GROUP BY book_id, base", scope="cross-entry"),
    _finding("D2", "NULL", "'MD boundary #' || base || '结束 has no matching start'", "md x WHERE NOT o AND NOT EXISTS (SELECT 1 FROM md y WHERE y.o AND y.book_id = x.book_id AND y.base = x.base)", scope="cross-entry"),
])


@query(_D2, with_flawed(_MD))
def val_d2(spark, sf_dir):
    return validate.d2(flawed(spark, sf_dir))


_CLOSED = r"regexp_replace(content, '(?s)<%.*?%>', '', 'g')"
_B1 = f"""(SELECT book_id, content, length(content) - length({_CLOSED}) + strpos({_CLOSED}, '<%') AS place FROM txt WHERE contains({_CLOSED}, '<%'))"""
_LINE = "length(left(content, CAST({0} AS BIGINT))) - length(replace(left(content, CAST({0} AS BIGINT)), chr(10), '')) + 1"
_E2 = "(SELECT book_id, unnest(regexp_extract_all(content, '(?s)<%[-=](.*?)%>', 0)) AS x, unnest(regexp_extract_all(content, '(?s)<%[-=](.*?)%>', 1)) AS y FROM txt) WHERE contains(y, '{{')"
_TAGGED = f"tags_in AS (SELECT book_id, content FROM txt), {O.tags_cte('tags_in', 'book_id')}"
TEXT_SQL = f"""
{_finding("B1", "NULL", "'EJS block not closed near line ' || (" + _LINE.format("place - 1") + ")", _B1, "error", "assembled")}
UNION ALL {_finding("B2", "NULL", "'EJS brace unbalanced: net=' || net", "rng WHERE net <> 0", "error", "assembled")}
UNION ALL {_finding("C5", "NULL", "'XML tag </' || tag || '> has no open'", f"tok5 WHERE NOT o AND m < pm AND tag NOT IN ({_NOT})", "error", "assembled")}
UNION ALL {_finding("C4", "NULL", "'XML tag <' || tag || '> unclosed near line ' || (" + _LINE.format("a") + ")", f"(SELECT t.*, content FROM tok7 t JOIN txt USING (book_id) WHERE o AND coalesce(mate_o, true)) WHERE tag NOT IN ({_NOT})", "error", "assembled")}
UNION ALL {_finding("C3", "NULL", "'XML tag crossing: <' || tag || '> not closed before </' || other || '> near line ' || (" + _LINE.format("a") + ")", f"(SELECT x.book_id, x.tag, x.a, p.tag AS other, content FROM tag_pairs p JOIN tok7 x ON x.book_id = p.book_id AND x.o AND x.a > p.a AND x.a < p.z AND NOT (NOT coalesce(x.mate_o, true) AND x.mate_z < p.z) AND x.tag NOT IN ({_NOT}) AND p.tag NOT IN ({_NOT}) JOIN txt ON txt.book_id = x.book_id)", "error", "assembled")}
UNION ALL {_finding("E1", "NULL", "'Macro brace mismatch: opens=' || a || ', closes=' || z", "(SELECT book_id, len(regexp_extract_all(content, '\\{\\{')) AS a, len(regexp_extract_all(content, '\\}\\}')) AS z FROM txt) WHERE a <> z", "warning", "assembled")}
UNION ALL {_finding("E2", "NULL", "'EJS output block contains nested macro: ' || left(x, 60)", _E2, "warning", "assembled")}
"""


@query(TEXT_SQL, with_flawed(f"{_TEXTS}, {O.blocks_cte('txt')}, {O.ranges_cte()}, {_TAGGED}"))
def val_text(spark, sf_dir):
    return validate.prompt_findings(prompt.sections(flawed(spark, sf_dir)))


_ALL = " UNION ALL ".join([*ENTRY_SQL.values(), _F6, _D2, TEXT_SQL])


@query(_ALL, with_flawed(f"{_MD}, {_TEXTS}, {O.blocks_cte('txt')}, {O.ranges_cte()}, {_TAGGED}"))
def validate_all(spark, sf_dir):
    return validate.validate(flawed_view(spark, sf_dir), strict=True)


_TOTALS = f"""SELECT book_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'error') = 0 AS passed
  FROM (SELECT book_id, NULL AS level FROM (SELECT DISTINCT book_id FROM full_entries) UNION ALL SELECT book_id, level FROM (SELECT * FROM ({_ALL}) WHERE book_id % 4 <> 1)) GROUP BY book_id"""


@query(_TOTALS, with_flawed(f"{_MD}, {_TEXTS}, {O.blocks_cte('txt')}, {O.ranges_cte()}, {_TAGGED}"))
def val_totals(spark, sf_dir):
    """Totals of all books, of which a quarter counts as mended."""
    rows = flawed_view(spark, sf_dir)
    return validate.totals(validate.validate(rows, strict=True).filter("book_id % 4 <> 1"), rows.select("book_id"))


_QUARANTINED = " UNION ALL ".join([
    _finding("Q1", "uid", "'code block braces out of proportion'", "full_entries WHERE uid % 23 = 5"),
    _finding("Q2", "uid", "'order is null, 100 is taken'", "full_entries WHERE uid % 19 = 3"),
    _finding("Q3", "uid", "'position is null, 0 is taken'", "full_entries WHERE uid % 29 = 7"),
])


@query(_QUARANTINED, with_full("one AS (SELECT 1)"))
def val_quarantine(spark, sf_dir):
    """Q1 to Q3 on entries with planted braces and nulls."""
    rows = entries_view(spark, sf_dir).withColumns({
        "content": F.when(F.col("uid") % 23 == 5, F.concat(F.lit("<% " + "{" * 25 + " %>\n"), "content")).otherwise(F.col("content")),
        "ord": F.when(F.col("uid") % 19 != 3, F.col("ord")), "position": F.when(F.col("uid") % 29 != 7, F.col("position")),
    })
    return validate.quarantine(rows)


_FACTS = f"""facts AS (SELECT book_id, min(ord) AS lo, max(ord) AS hi, count(*) AS n, min(ord) = 0 AND max(ord) = count(*) - 1 AND count(DISTINCT ord) = count(*) AS oc,
  min(uid) = 0 AND max(uid) = count(*) - 1 AND count(DISTINCT uid) = count(*) AS uc, coalesce(max(ord) FILTER (NOT moving), -1) AS sm, coalesce(min(ord) FILTER (moving), count(*)) AS dm
  FROM (SELECT *, {O.label()} IN ('boundary', 'supplement', 'dynamic') AS moving FROM full_entries) GROUP BY book_id)"""
_ARTIFACT = " UNION ALL ".join([
    _finding("P1", "NULL", "CASE WHEN lo <> 0 OR hi <> n - 1 THEN 'order not continuous: range ' || lo || '..' || hi || ', expected 0..' || (n - 1) ELSE 'order not continuous' END", "facts WHERE NOT oc", "error", "file"),
    _finding("P2", "NULL", "'uid not continuous'", "facts WHERE NOT uc", "error", "file"),
    _finding("P5", "NULL", "'static entries (max order=' || sm || ') after dynamic entries (min order=' || dm || ')'", "facts WHERE sm >= 0 AND dm < n AND sm > dm", "error", "file"),
])


@query(_ARTIFACT, with_flawed(_FACTS))
def val_artifact(spark, sf_dir):
    return validate.check_artifact(flawed_view(spark, sf_dir))


_CHAIN = " UNION ALL ".join([
    _finding("CH1", "NULL", "'reordered is missing'", "chain", "error", "file"),
    _finding("CH2", "NULL", "'split (' || s || ') < analysis (' || a || ')'", "chain WHERE s < a", "warning", "file"),
    _finding("CH3", "NULL", "'no backup file found'", "chain WHERE book_id <= 3", "warning", "file"),
])


@query(_CHAIN, with_full(f"{O.split_ctes()}, chain AS (SELECT book_id, (SELECT count(*) FROM full_entries f WHERE f.book_id = n.book_id) AS a, count(*) FILTER (book_id % 2 = 0 OR seq % 3 = 0) AS s FROM split_out n GROUP BY book_id)"))
def val_chain(spark, sf_dir):
    """The chain of every book, of which the split one lost entries in half of the books and the reordered one is not there."""
    rows = entries_view(spark, sf_dir)
    split = pipeline.split(rows).filter("book_id % 2 = 0 or seq % 3 = 0")
    return validate.check_chain(rows, split, rows.limit(0), split, rows.select("book_id").filter("book_id > 3").distinct())


_CHAIN_FILES = """n AS (SELECT book_id, count(*) AS a, count(*) FILTER (uid % 3 = 0) AS s FROM entries GROUP BY book_id)"""
_CHAINED = " UNION ALL ".join([
    "SELECT 'book' || book_id AS stem, 'CH1' AS code, 'error' AS level, 'missing: book' || book_id || '_reordered.json' AS message FROM n WHERE book_id = 2",
    "SELECT 'book' || book_id, 'CH2', 'warning', 'split (' || s || ') < analysis (' || a || ')' FROM n WHERE book_id % 2 = 1",
    "SELECT 'book' || book_id, 'CH3', 'warning', 'no backup file found' FROM n WHERE book_id > 4",
])


@query(_CHAINED, f"{O.ENTRIES}, {_CHAIN_FILES}")
def chain_files(spark, sf_dir):
    """Books written as files of each step and checked as files: some lost entries, one has no reordered file."""
    folder = f"{shared_folder(spark)}/promptweave-chain-{uuid.uuid4().hex}"
    system, place = hadoop(spark, folder)
    system.mkdirs(place)
    system.deleteOnExit(place)
    rows = full(spark, sf_dir)
    names = rows.select("book_id").distinct().withColumn("stem", F.concat(F.lit("book"), F.col("book_id").cast("string")))
    lost = rows.filter("book_id % 2 = 0 or uid % 3 = 0")
    for step, df, own in (("analysis", rows, names), ("split", lost, names), ("reordered", lost, names.filter("book_id <> 2")), ("merged", lost, names)):
        artifacts.write_books(df, own, folder, step)
    backups = names.filter("book_id <= 4").select(F.concat("stem", F.lit(".backup_1.json")).alias("name"), F.lit("{}").alias("value"))
    artifacts.write_files(backups, folder)
    missing, counts, kept = artifacts.chain_of_files(spark, folder)
    return validate.check_files(missing, counts, kept, names).select("stem", "code", "level", "message")


@query(_finding("P3", "uid", "'temporary field ''_pair_id'' found'", "full_entries WHERE seq % 9 = 4"), with_flawed("one AS (SELECT 1)"))
def val_residue(spark, sf_dir):
    """P3 on entries that carry a field of the steps."""
    said = F.concat(F.lit('{"uid":'), F.col("uid").cast("string"), F.when(F.col("seq") % 9 == 4, F.lit(',"_pair_id":1')).otherwise(""), F.lit("}"))
    rows = flawed_view(spark, sf_dir).withColumn("raw", F.from_json(said, "map<string,variant>"))
    return validate.check_artifact(rows).filter("code = 'P3'")


@query(_finding("P0", "NULL", "'entries list is empty'", "(SELECT CAST(unnest([100, 101]) AS BIGINT) AS book_id)", "error", "file"))
def val_missing(spark, sf_dir):
    """P0 for books without entries, among those that have some."""
    rows = entries_view(spark, sf_dir)
    return validate.missing_books(rows.select("book_id").distinct().unionByName(spark.range(100, 102).select(F.col("id").alias("book_id"))), rows)


def _as_files(rows: DataFrame, as_list: bool, key: Column, entry: Column) -> DataFrame:
    """A row per book: its entries as the JSON of a map under `key`, or of a list."""
    one = entry if as_list else F.concat(F.lit('"'), key.cast("string"), F.lit('":'), entry)
    listed = rows.select("book_id", F.struct("seq", one.alias("json")).alias("x")).groupBy("book_id").agg(F.array_sort(F.collect_list("x")).alias("all"))
    inner = F.array_join(F.transform("all", lambda x: x["json"]), ",")
    ends = ("[", "]") if as_list else ("{", "}")
    return listed.select("book_id", F.concat(F.lit('{"entries":' + ends[0]), inner, F.lit(ends[1] + "}")).alias("value"))


_FILES = " UNION ALL ".join([
    _finding("A3", "uid", "'uid=' || uid || ' != entries key=' || (uid + 1000000)", "full_entries WHERE uid % 6 = 5", "error"),
    _finding("A4", "uid", "'content field missing'", "full_entries WHERE uid % 7 = 3", "error"),
])


@query(_FILES, with_full("one AS (SELECT 1)"))
def val_files(spark, sf_dir):
    """A3 and A4 on books as JSON."""
    bare = F.col("uid") % 7 == 3
    key = F.when(F.col("uid") % 6 == 5, F.col("uid") + 1_000_000).otherwise(F.col("uid"))
    entry = F.when(bare, F.to_json(F.struct("uid", "comment"))).otherwise(F.to_json(F.struct("uid", "comment", "content")))
    return validate.file_rules(books.parse_books(_as_files(entries_view(spark, sf_dir), False, key, entry)))


@query("SELECT doc_id AS book_id, CASE WHEN doc_id % 5 = 2 THEN 'A2' ELSE 'A1' END AS code FROM documents WHERE doc_id % 5 IN (2, 3)", "")
def val_damaged(spark, sf_dir):
    """A1 and A2 on files, one for each document."""
    said = {0: '{"entries":{"0":{}}}', 1: '{"entries":[]}', 2: '{"entries":3}', 3: '{"entries":{"0":', 4: "{}"}
    value = F.coalesce(*[F.when(F.col("doc_id") % 5 == k, F.lit(v)) for k, v in said.items()])
    found = books.damaged(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("doc_id").alias("book_id"), value.alias("value")))
    return found.select("book_id", "code")


# Lineage

_WS = P.WS
_SUFFIX = rf"'{_WS}*\[(split-static|split-dynamic|boundary-copy-open|boundary-copy-close)\]$'"
_SORT_OF = f"SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY {O.SORT_KEYS}, seq) - 1 AS rn FROM (SELECT *, {_ST} AS st, false AS cp, false AS sp FROM {{}})"
LINEAGE = f"""{O.PIPELINE}, o AS (SELECT *, {O.strip(f"regexp_replace(comment, {_SUFFIX}, '')")} AS base, {O.strip("content")} AS text FROM ({_SORT_OF.replace("{}", "full_entries")})), n AS (
  SELECT *, CASE WHEN contains(comment, '[split-static]') THEN 'split-static' WHEN contains(comment, '[split-dynamic]') THEN 'split-dynamic' WHEN starts_with(comment, '合并:') THEN 'merged'
    WHEN contains(comment, '[boundary-copy-') OR contains(comment, '[supplement-') THEN 'created' ELSE 'normal' END AS kind, {O.strip(f"regexp_replace(comment, {_SUFFIX}, '')")} AS base FROM ({_SORT_OF.replace("{}", "me_out")})
), e1 AS (SELECT o.book_id, o.rn AS orn, 1 AS rule, n.kind AS role, n.rn AS nrn FROM o JOIN n ON o.book_id = n.book_id AND o.base = n.base AND o.base <> '' AND n.kind LIKE 'split%'), lone AS (
  SELECT book_id, orn FROM e1 GROUP BY book_id, orn HAVING bool_or(role = 'split-dynamic') AND NOT bool_or(role = 'split-static')
), lone_tags0 AS (SELECT o.book_id, o.rn, o.content FROM o JOIN lone ON o.book_id = lone.book_id AND o.rn = lone.orn), {O.tags_cte("lone_tags0", "book_id, rn", "lone_tags").replace("tok", "lt")}, need AS (
  SELECT book_id, rn AS orn, 0 AS step, '<' || arg_max(tag, struct_pack(size := z - a, last := -z)) || '>' AS a, '</' || arg_max(tag, struct_pack(size := z - a, last := -z)) || '>' AS z FROM lone_tags GROUP BY book_id, rn
  UNION ALL SELECT book_id, rn, i, {O.strip("l")}, {O.strip("l")} FROM (SELECT book_id, rn, unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS l FROM (SELECT book_id, rn, list_filter({O.lines("content")}, lambda x: regexp_matches(x, '^#{{1,2}}{_WS}+([^\n])')) AS hs FROM lone_tags0))
  UNION ALL SELECT o.book_id, o.rn, 1000000, base, base FROM o JOIN lone ON o.book_id = lone.book_id AND o.rn = lone.orn WHERE base <> ''
), e1b AS (
  SELECT need.book_id, orn, 1 AS rule, 'merged' AS role, arg_min(n.rn, struct_pack(s := step, r := n.rn)) AS nrn FROM need JOIN n ON n.book_id = need.book_id AND n.kind = 'merged' AND contains(n.content, a) AND contains(n.content, z) GROUP BY need.book_id, orn
), e2 AS (SELECT o.book_id, o.rn AS orn, 2 AS rule, 'kept' AS role, min(n.rn) AS nrn FROM o JOIN n ON o.book_id = n.book_id AND n.kind = 'normal' AND o.base = n.comment AND o.base <> '' GROUP BY o.book_id, o.rn), e3 AS (
  SELECT o.book_id, o.rn AS orn, 3 AS rule, 'merged' AS role, min(n.rn) AS nrn FROM o JOIN n ON o.book_id = n.book_id AND n.kind = 'merged' AND ((o.text <> '' AND contains(n.content, o.text)) OR (o.text = '' AND n.position = o.position)) GROUP BY o.book_id, o.rn
), e4 AS (SELECT o.book_id, o.rn AS orn, 4 AS rule, 'kept' AS role, min(n.rn) AS nrn FROM o JOIN n ON o.book_id = n.book_id AND n.kind = 'normal' AND o.text <> '' AND {O.strip("n.content")} = o.text GROUP BY o.book_id, o.rn), e AS (
  FROM e1 UNION ALL FROM e1b UNION ALL FROM e2 UNION ALL FROM e3 UNION ALL FROM e4
), fwd AS (
  SELECT o.book_id, o.rn AS orig_rn, o.uid AS orig_uid, CASE e.rule WHEN 1 THEN 'split' WHEN 2 THEN 'kept' WHEN 3 THEN 'merged' WHEN 4 THEN 'kept' ELSE 'unknown' END AS type, e.role, n.rn AS opt_rn, n.uid AS opt_uid
  FROM o LEFT JOIN (SELECT * FROM e QUALIFY rule = min(rule) OVER (PARTITION BY book_id, orn)) e ON e.book_id = o.book_id AND e.orn = o.rn LEFT JOIN n ON n.book_id = e.book_id AND n.rn = e.nrn
)"""


def _both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = entries_view(spark, sf_dir)
    return rows, written(pipeline.pipeline(rows), "pipeline")  # a step's result is a table in use


@query("SELECT * FROM fwd", LINEAGE)
def lineage_forward(spark, sf_dir):
    return lineage.forward(*_both(spark, sf_dir))


_REVERSE = """src AS (
  SELECT n.book_id, n.rn, o.rn AS orn, o.uid AS ouid, 0 AS place FROM n JOIN o ON n.book_id = o.book_id AND n.base = o.base WHERE n.kind LIKE 'split%'
  UNION ALL SELECT n.book_id, n.rn, o.rn, o.uid, strpos(n.content, o.text) FROM n JOIN o ON n.book_id = o.book_id AND o.text <> '' AND contains(n.content, o.text) WHERE n.kind = 'merged'
  UNION ALL SELECT n.book_id, n.rn, arg_min(f.orig_rn, f.orig_rn), arg_min(f.orig_uid, f.orig_rn), 0 FROM n JOIN fwd f ON n.book_id = f.book_id AND n.uid = f.opt_uid WHERE n.kind = 'normal' GROUP BY n.book_id, n.rn
)"""


@query("""SELECT n.book_id, n.rn AS opt_rn, n.uid AS opt_uid, n.kind, CASE WHEN orn IS NOT NULL THEN row_number() OVER (PARTITION BY n.book_id, n.rn ORDER BY place, orn) - 1 END AS nth, orn AS orig_rn, ouid AS orig_uid
  FROM n LEFT JOIN src ON src.book_id = n.book_id AND src.rn = n.rn""", f"{LINEAGE}, {_REVERSE}")
def lineage_reverse(spark, sf_dir):
    return lineage.reverse(*_both(spark, sf_dir))


@query("""SELECT book_id, count(DISTINCT orig_rn) FILTER (type = 'split') AS n_split, count(*) FILTER (type = 'split') AS n_parts, count(DISTINCT orig_rn) FILTER (type = 'merged') AS n_merged,
  count(DISTINCT opt_rn) FILTER (type = 'merged') AS n_targets, count(DISTINCT orig_rn) FILTER (type = 'kept') AS n_kept, count(DISTINCT orig_rn) FILTER (type = 'unknown') AS n_unknown,
  (SELECT count(*) FROM n WHERE n.book_id = fwd.book_id AND kind = 'created') AS n_created FROM fwd GROUP BY book_id""", LINEAGE)
def lineage_summary(spark, sf_dir):
    return lineage.summary(*_both(spark, sf_dir))


def _change(col: str, name: str) -> str:
    def text(side: str) -> str:
        x = f"{side}.{col}"
        return f"CASE WHEN {x} THEN 'True' ELSE 'False' END" if col in ("constant", "use_probability") else f"coalesce(CAST({x} AS VARCHAR), 'None')"

    return f"CASE WHEN o.{col} IS DISTINCT FROM n.{col} THEN '{name}: ' || {text('o')} || ' → ' || {text('n')} END"


_CHANGES = ", ".join(_change(c, x) for c, x in (("position", "position"), ("constant", "constant"), ("use_probability", "useProbability"), ("depth", "depth"), ("role", "role"), ("ord", "order")))


@query(f"SELECT f.book_id, f.orig_rn, f.opt_rn, array_to_string(list_filter([{_CHANGES}], lambda x: x IS NOT NULL)[1:3], '; ') AS changes FROM fwd f JOIN o ON o.book_id = f.book_id AND o.rn = f.orig_rn JOIN n ON n.book_id = f.book_id AND n.rn = f.opt_rn WHERE f.type = 'kept'", LINEAGE)
def lineage_changes(spark, sf_dir):
    return lineage.kept_changes(*_both(spark, sf_dir))


_PLACE = "printf('uid=%s  order=%s  pos=%s  sorted=#%s', CAST(n.uid AS VARCHAR), CAST(n.ord AS VARCHAR), CAST(n.position AS VARCHAR), CAST(n.rn AS VARCHAR))"
_REPORT = f"""SELECT book_id, rn AS orig_rn, CAST(0 AS BIGINT) AS nth,
  printf('  #%-4s %-40s uid=%-3s order=%-3s pos=%s  const=%s', CAST(rn AS VARCHAR), comment, CAST(uid AS VARCHAR), CAST(ord AS VARCHAR), CAST(position AS VARCHAR), {O.mark("constant")}) AS line FROM o
UNION ALL SELECT f.book_id, f.orig_rn, row_number() OVER (PARTITION BY f.book_id, f.orig_rn ORDER BY f.role = 'merged', f.opt_rn), CASE f.type
  WHEN 'split' THEN '         └─ ' || CASE f.role WHEN 'split-dynamic' THEN '拆分→[动态]' WHEN 'split-static' THEN '拆分→[静态]' ELSE '拆分→[静态已合并]' END || '  ' || {_PLACE} || CASE WHEN n.comment <> '' THEN '  "' || n.comment || '"' ELSE '' END
  WHEN 'merged' THEN '         → 合并入  ' || {_PLACE} || '  "' || n.comment || '"'
  WHEN 'kept' THEN '         → 保持  uid=' || n.uid || '  sorted: #' || o.rn || ' → #' || n.rn || CASE WHEN len(ch) > 0 THEN '  |  ' || array_to_string(ch[1:3], '; ') ELSE '' END
  ELSE '         → ? 未知去向' END
FROM (SELECT fwd.*, list_filter([{_CHANGES}], lambda x: x IS NOT NULL) AS ch FROM fwd LEFT JOIN o ON o.book_id = fwd.book_id AND o.rn = fwd.orig_rn LEFT JOIN n ON n.book_id = fwd.book_id AND n.rn = fwd.opt_rn) f
JOIN o ON o.book_id = f.book_id AND o.rn = f.orig_rn LEFT JOIN n ON n.book_id = f.book_id AND n.rn = f.opt_rn"""


@query(_REPORT, LINEAGE)
def lineage_report(spark, sf_dir):
    return lineage.report_lines(*_both(spark, sf_dir))


@query(f"""SELECT o.book_id, count(*) AS n_before, (SELECT count(*) FROM n WHERE n.book_id = o.book_id) AS n_after,
  string_agg(o.uid || ':' || o.comment || ':' || t.type || ':' || t.targets, ';' ORDER BY o.rn) AS matches, (SELECT string_agg(uid || ':' || comment, ';' ORDER BY rn) FROM n WHERE n.book_id = o.book_id AND kind = 'created') AS created
  FROM o JOIN (SELECT book_id, orig_rn, min(type) AS type, coalesce(string_agg(opt_uid || ' ' || role, ',' ORDER BY role = 'merged', opt_rn), '') AS targets FROM fwd GROUP BY ALL) t ON t.book_id = o.book_id AND t.orig_rn = o.rn GROUP BY o.book_id""", LINEAGE)
def diff_document(spark, sf_dir):
    """The JSON document of a rearrangement, read back."""
    told = reports.diff_document(*_both(spark, sf_dir), ("old", "new"))
    kind = "struct<entry_count:struct<before:bigint,after:bigint>,matches:array<struct<uid:bigint,comment:string,type:string,targets:array<struct<uid:bigint,role:string>>>>,created:array<struct<uid:bigint,comment:string,type:string>>>"
    rows = told.select("book_id", F.from_json("document", kind).alias("d"))
    target = lambda t: F.concat_ws(" ", t["uid"].cast("string"), t["role"])
    match = lambda m: F.concat_ws(":", m["uid"].cast("string"), m["comment"], m["type"], F.array_join(F.transform(m["targets"], target), ","))
    made = lambda c: F.concat_ws(":", c["uid"].cast("string"), c["comment"])
    created = F.when(F.size("d.created") > 0, F.array_join(F.transform("d.created", made), ";"))
    return rows.select("book_id", F.col("d.entry_count.before").alias("n_before"), F.col("d.entry_count.after").alias("n_after"), F.array_join(F.transform("d.matches", match), ";").alias("matches"), created.alias("created"))


# Files

# Fixed values, stated apart from the writer's: a new entry's fields in file order.
_FIELDS = """uid null; key []; keysecondary []; comment ""; content ""; constant false; disable false; selective true; selectiveLogic 0; order 100; position 0;
depth 4; role null; probability 100; useProbability true; sticky 0; cooldown 0; delay 0; scanDepth null; caseSensitive null; matchWholeWords null;
useGroupScoring null; matchPersonaDescription false; matchCharacterDescription false; matchCharacterPersonality false; matchCharacterDepthPrompt false;
matchScenario false; matchCreatorNotes false; excludeRecursion false; preventRecursion false; delayUntilRecursion 0; ignoreBudget false; group "";
groupOverride false; groupWeight 100; outletName ""; automationId ""; vectorized false; addMemo false; triggers [];
characterFilter {"isExclude":false,"names":[],"tags":[]}; displayIndex null"""


_DEFAULTS = "(VALUES " + ", ".join(f"({i}, {O.q(k)}, {O.q(v)})" for i, (k, v) in enumerate(x.strip().split(" ", 1) for x in _FIELDS.split(";"))) + ") AS f(place, field, value)"


@query(f"""SELECT book_id, CAST(place AS INT) AS place, field, CASE field WHEN 'uid' THEN CAST(seq AS VARCHAR) WHEN 'comment' THEN '"' || comment || '"' ELSE value END AS value
  FROM entries, {_DEFAULTS} WHERE content = ''""")
def default_fields(spark, sf_dir):
    """Fields of entries that give but a uid and a comment, as the writer fills them in."""
    rows = entries_view(spark, sf_dir).filter("content = ''").select("book_id", "seq", "uid", "comment", F.lit(None).cast("map<string,variant>").alias("raw"))
    made = rows.select("book_id", F.from_json(books.new_entry_json(rows), "map<string,variant>").alias("f"))
    return made.select("book_id", F.posexplode("f").alias("place", "field", "v")).select("book_id", "place", "field", F.coalesce(F.to_json("v"), F.lit("null")).alias("value"))


@query("SELECT book_id, seq, uid, ord, position, depth, constant, disable, comment, md5(content) AS content_md5 FROM entries")
def json_round_trip(spark, sf_dir):
    """Books written as JSON and read again."""
    again = books.parse_books(books.book_json(full(spark, sf_dir)))
    return again.select("book_id", "seq", "uid", "ord", "position", "depth", "constant", "disable", "comment", F.md5(F.col("content")).alias("content_md5"))


_LISTED = """SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY seq) - 1 AS seq, CAST(row_number() OVER (PARTITION BY book_id ORDER BY seq) - 1 AS VARCHAR) AS map_key,
  uid, comment, md5(content) AS content_md5 FROM entries"""


@query(_LISTED)
def list_books(spark, sf_dir):
    """Books whose entries are a JSON list."""
    rows = entries_view(spark, sf_dir)
    again = books.parse_books(_as_files(rows, True, F.col("uid"), F.to_json(F.struct("uid", "comment", "content"))))
    return again.select("book_id", "seq", "map_key", "uid", "comment", F.md5(F.col("content")).alias("content_md5"))


@query("SELECT doc_id AS book_id, md5(text) AS description_md5, lang AS personality, CASE WHEN doc_id % 2 = 0 THEN source END AS scenario FROM documents", "")
def character_cards(spark, sf_dir):
    """Character cards as JSON, some without a scenario."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    value = F.to_json(F.struct(F.col("text").alias("description"), F.col("lang").alias("personality"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("scenario"), F.lit(1).alias("other")))
    return books.character_card(docs.select(F.col("doc_id").alias("book_id"), value.alias("value"))).select("book_id", F.md5("description").alias("description_md5"), "personality", "scenario")


@query("SELECT conv_id AS book_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, coalesce(role, 'user') AS role, md5(coalesce(text, '')) AS text_md5 FROM conversations", "")
def chat_round_trip(spark, sf_dir):
    """Conversations as chat files, parsed again."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").alias("book_id"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    files = told.agg(F.to_json(F.struct(listed.alias("messages"))).alias("value"))
    return books.chat_messages(files).select("book_id", "turn", "role", F.md5("text").alias("text_md5"))


