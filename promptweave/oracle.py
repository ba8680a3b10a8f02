"""DuckDB SQL for the registered queries, written apart from the Spark code: the same results by other means."""

from __future__ import annotations

from promptweave.functions import patterns as P
from promptweave.views import ENTRIES_SQL, FLAWED_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{P.WS}+|{P.WS}+\z', '', 'g')"


def static(x: str) -> str:
    return "NOT (" + " OR ".join(f"regexp_matches({x}, {q(p)})" for _, p in P.MARKERS) + ")"


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def plugin(content: str, comment: str) -> str:
    return f"({contains_any(comment, P.PLUGIN_COMMENTS)} OR starts_with({comment}, {q(P.PLUGIN_COMMENT_START)}) OR {contains_any(content, P.PLUGIN_DECORATORS)})"


def residue(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?s)<%[-_=#]?.*?%>', '', 'g'), '\{{\{{.*?\}}\}}', '', 'g')"


def lines(x: str) -> str:
    return f"regexp_extract_all({x}, {q(P.LINE)}, 0)"


def braces(x: str) -> str:
    bare = f"regexp_replace({x}, {q(P.CODE_LITERALS)}, ' ', 'g')"
    return f"(length(replace({bare}, '}}', '')) - length(replace({bare}, '{{', '')))"


def bare(x: str) -> str:
    return rf"{strip(rf"regexp_replace(regexp_replace({x}, '</?{P.NAME}+>', '', 'g'), '(?m)^#{{1,2}}{P.WS}.*$', '', 'g')")} = ''"


def no_tag_lines(x: str) -> str:
    return rf"regexp_replace({x}, '(?m)^{P.WS}*</?{P.NAME}+>{P.WS}*$\n?', '', 'g')"


def label(content: str = "content", comment: str = "comment") -> str:
    return f"CASE WHEN starts_with({comment}, '{P.MERGED}') THEN 'merged' WHEN contains({comment}, '{P.COPY}') THEN 'boundary' WHEN contains({comment}, '{P.SUPPLEMENT}') THEN 'supplement' WHEN {static(content)} THEN 'static' ELSE 'dynamic' END"


def mark(x: str) -> str:
    return f"CASE WHEN {x} THEN '✓' ELSE '✗' END"


ENTRIES = f"entries AS ({ENTRIES_SQL})"
# Columns of an entry that the view leaves at their defaults.
FULL = """full_entries AS (
  SELECT book_id, seq, uid, comment, content, ord, position, depth, constant, disable, CAST([] AS VARCHAR[]) AS key, CAST(NULL AS INT) AS role,
    100 AS probability, false AS use_probability, 0 AS sticky, 0 AS cooldown, 0 AS delay FROM entries
)"""
#: Both for the view with planted mistakes.
FLAWED = f"""entries AS ({FLAWED_SQL}), full_entries AS (
  SELECT book_id, seq, uid, comment, content, ord, position, depth, constant, disable, CASE WHEN keyed THEN ['k'] ELSE CAST([] AS VARCHAR[]) END AS key, CAST(NULL AS INT) AS role,
    probability, use_probability, 0 AS sticky, 0 AS cooldown, 0 AS delay FROM entries
)"""
COLUMNS = "book_id, seq, uid, comment, content, ord, position, depth, constant, disable, key, role, probability, use_probability, sticky, cooldown, delay"

# Code blocks: a fold over the lines.

_BODY_END = "CASE WHEN contains({r}, '%>') THEN length({r}) - strpos(reverse({r}), '>%') - 1 ELSE length({r}) END"


def _body(r: str) -> str:
    begin = rf"length(regexp_extract({r}, '(?s)\A(.*?{P.CODE_OPEN})', 1))"
    return f"substring({r}, {begin} + 1, greatest({_BODY_END.format(r=r)} - {begin}, 0))"


def blocks_cte(source: str) -> str:
    """blk: source with ls (lines) and bl (blocks)."""
    kind = "STRUCT(kind VARCHAR, body VARCHAR, s INT, e INT)[]"
    whole = r"regexp_matches(regexp_extract(x.l, '(?s)<%(.*)\z', 1), '%>')"
    fold = f"""list_reduce(list_transform(ls, lambda y: {{'l': y, 'i': 0, 'since': -1, 'raw': '', 'out': CAST([] AS {kind})}}), lambda a, x: {{
      'l': '', 'i': a.i + 1,
      'since': CASE WHEN a.since >= 0 AND NOT contains(x.l, '%>') THEN a.since WHEN a.since < 0 AND contains(x.l, '<%') AND NOT {whole} THEN a.i ELSE -1 END,
      'raw': CASE WHEN (a.since >= 0 AND NOT contains(x.l, '%>')) OR (a.since < 0 AND contains(x.l, '<%') AND NOT {whole}) THEN a.raw || x.l ELSE '' END,
      'out': CASE
        WHEN a.since >= 0 AND contains(x.l, '%>') THEN list_append(a.out, {{'kind': 'ejs', 'body': {_body("(a.raw || x.l)")}, 's': a.since, 'e': a.i}})
        WHEN a.since >= 0 THEN a.out
        WHEN contains(x.l, '<%') AND {whole} THEN list_append(a.out, {{'kind': 'ejs', 'body': {_body("x.l")}, 's': a.i, 'e': a.i}})
        WHEN contains(x.l, '<%') THEN a.out
        ELSE list_append(a.out, {{'kind': 'text', 'body': x.l, 's': a.i, 'e': a.i}}) END
    }}, {{'l': '', 'i': 0, 'since': -1, 'raw': '', 'out': CAST([] AS {kind})}})"""
    return f"""blk0 AS (SELECT *, {lines("content")} AS ls FROM {source}), blk1 AS (SELECT *, {fold} AS f FROM blk0), blk2 AS (
  SELECT * EXCLUDE (f), CASE WHEN f.since >= 0 THEN list_append(f.out, {{'kind': 'ejs', 'body': {_body("f.raw")}, 's': f.since, 'e': f.i - 1}}) ELSE f.out END AS b0 FROM blk1
), blk AS (
  SELECT * EXCLUDE (b0), list_transform(b0, lambda b: {{'kind': b.kind, 'body': CASE WHEN b.kind = 'ejs' THEN {strip("b.body")} ELSE b.body END, 's': b.s, 'e': b.e, 'd': CASE WHEN b.kind = 'ejs' THEN {braces("b.body")} ELSE 0 END}}) AS bl FROM blk2
)"""


def ranges_cte(source: str = "blk") -> str:
    """rng: source with rg (ranges under open braces) and net (sum of brace differences)."""
    kind = "STRUCT(s INT, e INT)[]"
    start = f"{{'d': 0, 's': 0, 'e': 0, 'since': CAST(NULL AS INT), 'out': CAST([] AS {kind})}}"
    since = "CASE WHEN a.since IS NULL AND a.d + x.d > 0 THEN x.s ELSE a.since END"
    ends = f"(a.d + x.d = 0 AND {since} IS NOT NULL)"
    fold = f"""list_reduce(list_transform(list_filter(bl, lambda b: b.kind = 'ejs'), lambda b: {{'d': CAST(b.d AS INT), 's': b.s, 'e': b.e, 'since': CAST(NULL AS INT), 'out': CAST([] AS {kind})}}), lambda a, x: {{
      'd': a.d + x.d, 's': 0, 'e': 0, 'since': CASE WHEN NOT {ends} THEN {since} END, 'out': CASE WHEN {ends} THEN list_append(a.out, {{'s': {since}, 'e': x.e}}) ELSE a.out END
    }}, {start})"""
    return f"""rng0 AS (SELECT *, {fold} AS f FROM {source}), rng AS (
  SELECT * EXCLUDE (f), f.d AS net, CASE WHEN f.since IS NOT NULL THEN list_append(f.out, {{'s': f.since, 'e': CAST(greatest(len(ls) - 1, 0) AS INT)}}) ELSE f.out END AS rg FROM rng0
)"""


def classes_cte(source: str = "rng") -> str:
    """cls: source with st (static) and mixed0 (mixed before outlets and plugins)."""
    covered = "len(rg) > 0 AND len(list_filter(range(0, len(ls)), lambda i: len(list_filter(rg, lambda r: r.s <= i AND i <= r.e)) = 0)) = 0"
    return f"cls AS (SELECT *, {static('content')} AS st, NOT ({static('content')}) AND {strip(residue('content'))} <> '' AND NOT ({covered}) AS mixed0 FROM {source})"


# Tags: pairs by running sums over each name.


def tags_cte(source: str, keys: str, name: str = "tag_pairs") -> str:
    """name: keys, tag, a (open), z (close end) of tag pairs; keys identify a row of source."""
    shape = f"(?s)(.*?)<(/?)({P.NAME}+)>"
    return f"""tok0 AS (
  SELECT {keys}, regexp_extract_all(content, {q(shape)}, 1) AS g, regexp_extract_all(content, {q(shape)}, 2) AS c, regexp_extract_all(content, {q(shape)}, 3) AS n FROM {source}
), tok1 AS (SELECT {keys}, unnest(range(1, len(n) + 1)) AS i, unnest(g) AS g, unnest(c) AS c, unnest(n) AS n FROM tok0), tok2 AS (
  SELECT *, CAST(sum(length(g) + length(c) + length(n) + 2) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) AS z FROM tok1
), tok3 AS (
  SELECT {keys}, n AS tag, i, c = '' AS o, z - length(c) - length(n) - 2 AS a, z,
    sum(CASE WHEN c = '' THEN 1 ELSE -1 END) OVER (PARTITION BY {keys}, n ORDER BY i) AS s FROM tok2
), tok4 AS (SELECT *, least(0, min(s) OVER (PARTITION BY {keys}, tag ORDER BY i)) AS m FROM tok3), tok5 AS (
  SELECT *, coalesce(lag(m) OVER (PARTITION BY {keys}, tag ORDER BY i), 0) AS pm FROM tok4
), tok6 AS (SELECT *, CASE WHEN o THEN s - m ELSE s - m + 1 END AS lvl FROM tok5 WHERE o OR m >= pm), tok7 AS (
  SELECT *, lead(o) OVER w AS mate_o, lead(z) OVER w AS mate_z FROM tok6 WINDOW w AS (PARTITION BY {keys}, tag, lvl ORDER BY i)
), {name} AS (SELECT {keys}, tag, a, mate_z AS z FROM tok7 WHERE o AND NOT coalesce(mate_o, true))"""


# Analysis and split


def analysis_ctes(source: str = "full_entries") -> str:
    """ana: one row per entry with st, mixed, rg, segs (segments or null)."""
    heading = q(P.HEADING)
    close = rf"'\A{P.WS}*</({P.NAME}+)>{P.WS}*\z'"
    under = "len(list_filter(rg, lambda r: (r.s <= x.s AND x.s <= r.e) OR (r.s <= x.e AND x.e <= r.e))) > 0"
    return f"""{blocks_cte(source)}, {ranges_cte()}, {classes_cte()}, ana0 AS (
  SELECT *, mixed0 AND NOT (position = 7 OR {plugin("content", "comment")}) AS mixed FROM cls
), spl0 AS (SELECT * FROM ana0 WHERE mixed AND net = 0), {tags_cte("spl0", "book_id, seq")}, outer_tag AS (
  SELECT book_id, seq, arg_max(tag, struct_pack(size := z - a, last := -z)) AS tag, list(DISTINCT tag) AS names FROM tag_pairs GROUP BY book_id, seq
), spl1 AS (
  SELECT s.*, t.tag AS outer_name, list_filter(range(0, len(ls)), lambda i: regexp_matches(ls[i + 1], {close}) AND list_contains(coalesce(t.names, []), regexp_extract(ls[i + 1], {close}, 1))) AS closes,
    list_sort(list_distinct(list_concat([0], list_filter(range(0, len(ls)), lambda i: regexp_matches(ls[i + 1], {heading}))))) AS starts
  FROM spl0 s LEFT JOIN outer_tag t USING (book_id, seq) WHERE len(ls) > 0
), spl2 AS (
  SELECT *, list_transform(starts, lambda x, i: {{'s': x, 'e': coalesce(starts[i + 1], len(ls)) - 1}}) AS sg FROM spl1
), spl3 AS (
  SELECT * EXCLUDE (sg), unnest(sg) AS x FROM spl2
), spl4 AS (
  SELECT *, (x.s <> x.e AND {under}) OR NOT ({static("array_to_string(ls[x.s + 1 : x.e + 1], '')")}) AS dyn, list_filter(closes, lambda c: x.s <= c AND c < x.e) AS inner_closes,
    CASE WHEN regexp_matches(ls[x.s + 1], {heading}) THEN length(regexp_extract(ls[x.s + 1], {heading}, 1)) END AS level,
    CASE WHEN regexp_matches(ls[x.s + 1], {heading}) THEN {strip(f"regexp_extract(ls[x.s + 1], {heading}, 2)")} ELSE '' END AS heading FROM spl3
), spl5 AS (
  SELECT *, unnest(list_concat([x.s], list_transform(inner_closes, lambda c: c + 1))) AS s1, unnest(list_concat(inner_closes, [x.e])) AS e1 FROM spl4
), seg AS (
  SELECT book_id, seq, level, heading, CAST(s1 AS BIGINT) AS s1, CAST(e1 AS BIGINT) AS e1, dyn, CASE WHEN NOT coalesce(s1 > list_max(closes), false) THEN outer_name END AS wrap_tag,
    array_to_string(ls[s1 + 1 : e1 + 1], '') AS piece FROM spl5
), seg_ok AS (SELECT book_id, seq FROM seg GROUP BY book_id, seq HAVING bool_or(dyn) AND bool_or(NOT dyn))"""


def split_ctes(source: str = "full_entries") -> str:
    """split_out: entries after the split."""
    text = no_tag_lines("piece")
    return f"""{analysis_ctes(source)}, half AS (
  SELECT book_id, seq, dyn, min(wrap_tag) AS tag, string_agg({text}, chr(10) || chr(10) ORDER BY s1) FILTER (wrap_tag IS NOT NULL) AS inside,
    string_agg({text}, chr(10) || chr(10) ORDER BY s1) FILTER (wrap_tag IS NULL) AS outside
  FROM seg SEMI JOIN seg_ok USING (book_id, seq) WHERE NOT ({bare("piece")}) GROUP BY book_id, seq, dyn
), both_halves AS (SELECT book_id, seq FROM half GROUP BY book_id, seq HAVING count(*) = 2), halves AS (
  SELECT book_id, seq, dyn, concat_ws(chr(10) || chr(10), CASE WHEN inside IS NOT NULL THEN '<' || tag || '>' || chr(10) || inside || chr(10) || '</' || tag || '>' END, outside) AS text
  FROM half SEMI JOIN both_halves USING (book_id, seq)
), unnumbered AS (
  SELECT * REPLACE ({strip("comment || CASE WHEN h.dyn THEN ' " + P.SPLIT_DYNAMIC + "' ELSE ' " + P.SPLIT_STATIC + "' END")} AS comment, h.text AS content), h.dyn AS side FROM {source} e JOIN halves h USING (book_id, seq)
  UNION ALL BY NAME SELECT *, false AS side FROM {source} ANTI JOIN halves USING (book_id, seq)
), split_out AS (
  SELECT * EXCLUDE (side, dyn, text) REPLACE (row_number() OVER w - 1 AS seq, row_number() OVER w - 1 AS uid) FROM unnumbered WINDOW w AS (PARTITION BY book_id ORDER BY seq, side)
)"""


# Reorder


def boundary(x: str) -> str:
    """struct(kind, name, copy) or null."""
    text = strip(x)
    tag, end = rf"regexp_extract({text}, '\A<({P.NAME}+)>', 1)", rf"regexp_extract({text}, '\A</({P.NAME}+)>', 1)"
    found = f"list_filter(list_transform({lines(text)}, lambda y: {strip('y')}), lambda y: regexp_matches(y, {q(P.MD_BOUNDARY)}))[1]"
    piece = [f"regexp_extract({found}, {q(P.MD_BOUNDARY)}, {n})" for n in (1, 2, 3)]
    opens = ", ".join(q(w) for w in P.OPEN_WORDS)
    return f"""CASE WHEN {tag} <> '' AND NOT contains({text}, '</' || {tag} || '>') THEN {{'kind': 'xml_open', 'name': {tag}, 'copy': '<' || {tag} || '>'}}
    WHEN {end} <> '' AND NOT contains({text}, '<' || {end} || '>') THEN {{'kind': 'xml_close', 'name': {end}, 'copy': '</' || {end} || '>'}}
    WHEN {found} IS NOT NULL THEN {{'kind': CASE WHEN {piece[2]} IN ({opens}) THEN 'md_open' ELSE 'md_close' END, 'name': {strip(piece[1])}, 'copy': {piece[0]} || ' ' || {strip(piece[1])} || {piece[2]}}} END"""


def is_copy_content(x: str) -> str:
    return rf"(regexp_matches({strip(x)}, '\A</?{P.NAME}+>{P.WS}*\z') OR regexp_matches({strip(x)}, {q(P.MD_BOUNDARY)}))"


def pairs_ctes(source: str) -> str:
    """pr: boundary pairs of source."""
    w = "PARTITION BY book_id, position, b.name"
    return f"""bnd0 AS (SELECT *, {boundary("content")} AS b FROM {source} WHERE NOT (key = ['{P.ALWAYS_KEY}'] AND {is_copy_content("content")})), bnd AS (
  SELECT book_id, position, seq, ord, b, b.kind IN ('xml_open', 'md_open') AS o FROM bnd0 WHERE b IS NOT NULL
), bnd1 AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE -1 END) OVER ({w} ORDER BY ord, seq ROWS UNBOUNDED PRECEDING) AS s FROM bnd), bnd2 AS (
  SELECT *, least(0, min(s) OVER ({w} ORDER BY ord, seq ROWS UNBOUNDED PRECEDING)) AS m FROM bnd1
), bnd3 AS (SELECT *, coalesce(lag(m) OVER ({w} ORDER BY ord, seq), 0) AS pm FROM bnd2), bnd4 AS (
  SELECT *, CASE WHEN o THEN s - m ELSE s - m + 1 END AS lvl FROM bnd3 WHERE o OR m >= pm
), bnd5 AS (
  SELECT *, lead(o) OVER v AS mo, lead(seq) OVER v AS ms, lead(ord) OVER v AS mord, lead(b.copy) OVER v AS mcopy FROM bnd4 WINDOW v AS ({w}, lvl ORDER BY ord, seq)
), pos_rank AS (SELECT book_id, position, min(seq) AS pr FROM {source} GROUP BY book_id, position), dyn AS (
  SELECT book_id, ord FROM {source} WHERE NOT ({static("content")})
), pr AS (
  SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY pr, mord, ms) - 1 AS pair_no, position, b.name AS name, seq AS open_seq, ord AS open_ord, b.copy AS open_copy,
    ms AS close_seq, mord AS close_ord, mcopy AS close_copy,
    EXISTS (SELECT 1 FROM dyn d WHERE d.book_id = bnd5.book_id AND d.ord > bnd5.ord AND d.ord < bnd5.mord) AS has_dynamic
  FROM bnd5 JOIN pos_rank USING (book_id, position) WHERE o AND NOT coalesce(mo, true)
)"""


def style_cte(source: str) -> str:
    known = ", ".join(q(x) for x in (f"<{P.WRAPPER_NAME}>", f"</{P.WRAPPER_NAME}>", f"# {P.WRAPPER_NAME}开始", f"# {P.WRAPPER_NAME}结束"))
    return f"""sty AS (
  SELECT book_id, CAST(sum(len(regexp_extract_all(content, '<{P.NAME}+>'))) AS BIGINT) AS n_tags, CAST(sum(len(regexp_extract_all(content, '(?m)^#{{1,2}}{P.WS}'))) AS BIGINT) AS n_headings,
    bool_or(NOT ({static("content")})) AS has_dynamic, bool_or(comment IN ('{P.SUPPLEMENT_START}', '{P.SUPPLEMENT_END}') OR (key = ['{P.ALWAYS_KEY}'] AND {strip("content")} IN ({known}))) AS has_wrapper
  FROM {source} GROUP BY book_id
), style AS (SELECT *, CASE WHEN n_tags >= n_headings THEN 'xml' ELSE 'markdown' END AS style FROM sty)"""


def supplements_cte() -> str:
    name = P.WRAPPER_NAME
    return f"""supp AS (
  SELECT book_id, CASE WHEN style = 'xml' THEN '<{name}>' ELSE '# {name}开始' END AS content, '{P.SUPPLEMENT_START}' AS comment, 0 AS side FROM style WHERE has_dynamic AND NOT has_wrapper
  UNION ALL SELECT book_id, CASE WHEN style = 'xml' THEN '</{name}>' ELSE '# {name}结束' END, '{P.SUPPLEMENT_END}', 1 FROM style WHERE has_dynamic AND NOT has_wrapper
)"""


SORT_KEYS = """CASE WHEN NOT st OR cp OR sp THEN 1 ELSE 0 END, CASE WHEN NOT sp THEN 1 WHEN contains(comment, '[supplement-start]') THEN 0 ELSE 2 END,
  CASE WHEN position <> 4 OR depth IS NULL THEN 1 WHEN depth >= 10 THEN 0 ELSE 2 END, position, CASE WHEN position = 4 AND depth IS NOT NULL THEN -depth ELSE 0 END, ord"""


def rules(derived: str, st: str) -> str:
    """SELECT list with the field rules applied to the columns of an entry, but for ord, uid and seq."""

    def keep(col: str, value: str) -> str:
        return f"CASE WHEN position <> 7 AND ({derived} OR {st}) THEN {value} ELSE {col} END AS {col}"

    return f"""CASE WHEN position = 7 THEN constant WHEN {derived} THEN false WHEN {st} THEN true ELSE constant END AS constant,
  CASE WHEN position = 7 THEN depth WHEN {derived} OR NOT {st} THEN 0 WHEN position <> 4 THEN depth WHEN depth >= 10 THEN 9999 ELSE 0 END AS depth,
  CASE WHEN position = 7 THEN role WHEN {derived} OR NOT {st} OR position = 4 THEN 1 ELSE role END AS role,
  CASE WHEN position <> 7 AND {derived} THEN ['{P.ALWAYS_KEY}'] ELSE key END AS key,
  CASE WHEN position = 7 THEN position WHEN {derived} OR NOT {st} THEN 4 ELSE position END AS position,
  {keep("use_probability", "false")}, {keep("probability", "100")}, {keep("cooldown", "0")}, {keep("sticky", "0")}, {keep("delay", "0")}"""


def reorder_ctes(source: str) -> str:
    """re_out: entries after the reordering."""
    return f"""{pairs_ctes(source)}, {style_cte(source)}, {supplements_cte()}, cps AS (
  SELECT e.* REPLACE (open_copy AS content, {strip(f"comment || ' {P.COPY_OPEN}'")} AS comment, NULL AS uid), pair_no, 0 AS side FROM {source} e JOIN pr ON e.book_id = pr.book_id AND e.seq = open_seq WHERE has_dynamic
  UNION ALL SELECT e.* REPLACE (close_copy AS content, {strip(f"comment || ' {P.COPY_CLOSE}'")} AS comment, NULL AS uid), pair_no, 1 FROM {source} e JOIN pr ON e.book_id = pr.book_id AND e.seq = close_seq WHERE has_dynamic
), re0 AS (
  SELECT *, false AS cp, false AS sp, NULL AS pair_no, 0 AS batch, seq AS tie FROM {source}
  UNION ALL BY NAME SELECT * EXCLUDE (side), true AS cp, false AS sp, 1 AS batch, pair_no * 2 + side AS tie FROM cps
  UNION ALL BY NAME SELECT book_id, content, comment, false AS cp, true AS sp, NULL AS pair_no, 2 AS batch, side AS tie, 0 AS seq, 0 AS ord, 4 AS position, 0 AS depth, 1 AS role, false AS constant, false AS disable,
    CAST([] AS VARCHAR[]) AS key, 100 AS probability, false AS use_probability, 0 AS sticky, 0 AS cooldown, 0 AS delay, NULL AS uid FROM supp
), re1 AS (SELECT *, {static("content")} AS st FROM re0), re2 AS (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY {SORT_KEYS}, batch, tie) AS rn FROM re1
), ends AS (SELECT book_id, pair_no, min(rn) AS lo, max(rn) AS hi FROM re2 WHERE cp GROUP BY book_id, pair_no), void AS (
  SELECT book_id, pair_no FROM ends x WHERE NOT EXISTS (SELECT 1 FROM re2 y WHERE y.book_id = x.book_id AND y.rn > x.lo AND y.rn < x.hi AND NOT y.st AND NOT y.cp AND NOT y.sp)
), re3 AS (
  SELECT * FROM re2 r WHERE NOT (cp AND EXISTS (SELECT 1 FROM void v WHERE v.book_id = r.book_id AND v.pair_no = r.pair_no))
    AND NOT (sp AND NOT EXISTS (SELECT 1 FROM re2 y WHERE y.book_id = r.book_id AND NOT y.st AND NOT y.cp))
), re_out AS (
  SELECT book_id, row_number() OVER w - 1 AS seq, row_number() OVER w - 1 AS uid, comment, content, row_number() OVER w - 1 AS ord, disable, {rules("(cp OR sp)", "st")}
  FROM re3 WINDOW w AS (PARTITION BY book_id ORDER BY rn)
)"""


def merge_ctes(source: str) -> str:
    """me_out: entries after the merge."""
    can = f"position <> 7 AND NOT disable AND NOT contains(comment, '{P.COPY}') AND NOT contains(comment, '{P.SUPPLEMENT}') AND {static('content')}"
    return f"""me0 AS (SELECT *, {can} AS can FROM {source}), grp AS (
  SELECT book_id, position, constant, depth, count(*) AS n, min(seq) AS seen, string_agg(content, chr(10) || chr(10) ORDER BY ord, seq) AS content, min(ord) AS lo, max(ord) AS hi,
    arg_min(struct_pack(r := role), struct_pack(o := ord, s := seq)).r AS role FROM me0 WHERE can GROUP BY book_id, position, constant, depth
), me1 AS (
  SELECT {COLUMNS}, 0 AS batch, seen FROM (SELECT book_id, NULL AS seq, NULL AS uid, '{P.MERGED}' || lo || '-' || hi AS comment, content, lo AS ord, position, depth, constant, false AS disable,
    CAST([] AS VARCHAR[]) AS key, role, 100 AS probability, false AS use_probability, 0 AS sticky, 0 AS cooldown, 0 AS delay, seen FROM grp WHERE n > 1)
  UNION ALL BY NAME SELECT {COLUMNS}, 0 AS batch, seq AS seen FROM me0 e WHERE can AND EXISTS (SELECT 1 FROM grp g WHERE g.book_id = e.book_id AND g.position = e.position AND g.constant = e.constant AND g.depth IS NOT DISTINCT FROM e.depth AND n = 1)
  UNION ALL BY NAME SELECT {COLUMNS}, 1 AS batch, seq AS seen FROM me0 WHERE NOT can
), me_out AS (
  SELECT * EXCLUDE (batch, seen) REPLACE (row_number() OVER w - 1 AS seq, row_number() OVER w - 1 AS uid, row_number() OVER w - 1 AS ord) FROM me1 WINDOW w AS (PARTITION BY book_id ORDER BY ord, batch, seen)
)"""


PIPELINE = f"{ENTRIES}, {FULL}, {split_ctes()}, {reorder_ctes('split_out')}, {merge_ctes('re_out')}"
#: What the step queries return of an entry.
SHOWN = "book_id, seq, uid, ord, position, depth, constant, disable, array_to_string(key, ',') AS keys, role, probability, use_probability, sticky, cooldown, delay, comment, md5(content) AS content_md5"
