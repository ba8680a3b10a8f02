"""The four steps over many books at once: analyze, split, reorder, merge.  Each takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweave.functions import blocks as B
from promptweave.functions import patterns as P
from promptweave.functions import tags as G
from promptweave.functions import text as T
from promptweave.operators import boundaries as D
from promptweave.operators import entries as E
from promptweave.operators.ordered import by_ranges, in_ranges, numbered, placed
from promptweave.tables import written


# Analyze


def _piece(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "")


def split_segments(lines: Column, segments: Column, ranges: Column, closes: Column, tag: Column) -> Column:
    """array<struct<level, heading, start_line, end_line, is_dynamic, wrap_tag>>, null unless both kinds are among them.

    A segment with an end under open braces is dynamic, but a single line is judged by its markers, as any other.
    Segments are cut after closing-tag lines; the parts keep the whole's kind.  What comes after the last such line is
    not wrapped.
    """

    def kind(s: Column) -> Column:
        first, last = s["start_line"], s["end_line"]
        under = (B.in_ranges(first, ranges) | B.in_ranges(last, ranges)) & (first != last)
        return under | ~T.is_static(_piece(lines, first, last))

    judged = F.transform(segments, lambda s: F.struct(s["level"].alias("level"), s["heading"].alias("heading"), s["start_line"].alias("s"), s["end_line"].alias("e"), kind(s).alias("d")))

    def cut(s: Column) -> Column:
        inner = F.filter(closes, lambda c: (s["s"] <= c) & (c < s["e"]))
        starts = F.concat(F.array(s["s"]), F.transform(inner, lambda c: c + 1))
        ends = F.concat(inner, F.array(s["e"]))
        return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.struct(
            s["level"].alias("level"), s["heading"].alias("heading"), x["s"].alias("start_line"), x["e"].alias("end_line"), s["d"].alias("is_dynamic"),
            F.when(~F.coalesce(x["s"] > F.array_max(closes), F.lit(False)), tag).alias("wrap_tag"),
        ))

    cuts = F.flatten(F.transform(judged, cut))
    return F.when(F.exists(cuts, lambda x: x["is_dynamic"]) & F.exists(cuts, lambda x: ~x["is_dynamic"]), cuts)


def analyze(entries: DataFrame) -> DataFrame:
    """entries with markers, is_static, is_mixed, suggested_split, ranges, boundaries and quarantined.

    Outlets and plugin entries are never mixed or split; nor is a mixed entry with unclosed braces or without a place to
    split.  quarantined: a code block's braces are out of all proportion.  Row by row: nothing is shuffled.
    """
    content, comment = F.col("content"), F.col("comment")
    rows = E.complete(entries).withColumn("markers", T.markers(content)).withColumn("_lines", T.lines_of(content))
    # Most entries hold no code: they have no blocks to fold, no ranges and no segments.
    rows = rows.withColumn("_blocks", F.when(F.contains(content, F.lit("<%")), B.blocks_of(content)))
    n_lines = F.size("_lines")
    none = F.array().cast("array<struct<s:int,e:int>>")
    rows = rows.withColumn("ranges", F.when(F.col("_blocks").isNotNull(), B.compound_ranges(F.col("_blocks"), n_lines)).otherwise(none))
    static, mixed = B.classified(content, F.col("ranges"), n_lines)
    special = E.is_outlet(F.col("position")) | T.has_plugin(content, comment)
    rows = rows.withColumn("is_static", static).withColumn("is_mixed", F.when(static, False).otherwise(mixed) & ~special)
    unclosed = F.coalesce(B.is_unclosed(F.col("_blocks")), F.lit(False))
    rows = rows.withColumn("_spans", F.when(F.col("is_mixed") & ~unclosed, G.tag_spans(content)))
    rows = rows.withColumn("_segments", F.when(F.col("_spans").isNotNull(), G.heading_segments(F.col("_lines"))))
    rows = rows.withColumn("_closes", F.when(F.col("_spans").isNotNull(), G.close_lines(F.col("_lines"), F.col("_spans"))))
    found = split_segments(F.col("_lines"), F.col("_segments"), F.col("ranges"), F.col("_closes"), G.outermost(F.col("_spans")))
    rows = rows.withColumn("boundaries", F.when(F.col("_spans").isNotNull(), found))
    rows = rows.withColumn("suggested_split", F.col("boundaries").isNotNull())
    rows = rows.withColumn("quarantined", F.coalesce(B.bad_braces(F.col("_blocks")), F.lit(False)))
    return rows.drop("_lines", "_blocks", "_spans", "_segments", "_closes")


ANALYSIS = ["markers", "is_static", "is_mixed", "suggested_split", "ranges", "boundaries", "quarantined"]


def analysis_summary(analyzed: DataFrame) -> DataFrame:
    """A row per book: total, n_static, n_dynamic (neither static nor mixed), n_mixed."""
    return analyzed.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_static").alias("n_static"),
        F.count_if(~F.col("is_static") & ~F.col("is_mixed")).alias("n_dynamic"),
        F.count_if("is_mixed").alias("n_mixed"),
    )


# Split


def _joined(parts: Column) -> Column:
    """Segments as one text: those of the tag inside it, the others after it."""
    texts = F.transform(parts, lambda x: F.struct(x["wrap_tag"].alias("tag"), T.without_tag_lines(x["text"]).alias("text")))
    inner = F.filter(texts, lambda x: x["tag"].isNotNull())
    outer = F.filter(texts, lambda x: x["tag"].isNull())
    tag = F.get(inner, F.lit(0))["tag"]
    wrapped = F.concat(F.lit("<"), tag, F.lit(">\n"), F.array_join(F.transform(inner, lambda x: x["text"]), "\n\n"), F.lit("\n</"), tag, F.lit(">"))
    rest = F.when(F.size(outer) > 0, F.array_join(F.transform(outer, lambda x: x["text"]), "\n\n"))
    return F.array_join(F.array_compact(F.array(F.when(F.size(inner) > 0, wrapped), rest)), "\n\n")


def split(entries: DataFrame, analysis: DataFrame | None = None, ranges: bool | None = None) -> DataFrame:
    """Mixed entries become a static and a dynamic one, in this order; all are renumbered in place.

    analysis, if given, holds book_id, uid and the columns of `analyze`; of several rows with one uid the last by seq
    holds.  Without it entries are analyzed here, on their own row, so there is no join.
    """
    if analysis is None:
        rows = analyze(entries)
    else:
        last = analysis.groupBy("book_id", "uid").agg(F.max_by(F.struct("suggested_split", "boundaries"), "seq").alias("_a"))
        rows = E.complete(entries).join(last, ["book_id", "uid"], "left").withColumns({"suggested_split": F.coalesce(F.col("_a.suggested_split"), F.lit(False)), "boundaries": F.col("_a.boundaries")}).drop("_a")
    lines = T.lines_of(F.col("content"))
    parts = F.transform("boundaries", lambda b: F.struct(b["is_dynamic"].alias("is_dynamic"), b["wrap_tag"].alias("wrap_tag"), _piece(lines, b["start_line"], b["end_line"]).alias("text")))
    rows = rows.withColumn("_parts", F.when(F.col("suggested_split"), F.filter(parts, lambda p: ~T.is_bare(p["text"]))))
    rows = rows.withColumn("_still", F.filter("_parts", lambda p: ~p["is_dynamic"])).withColumn("_moving", F.filter("_parts", lambda p: p["is_dynamic"]))

    def child(side: int, parts: str, suffix: str) -> Column:
        return F.struct(F.lit(side).alias("side"), _joined(F.col(parts)).alias("content"), T.strip(F.concat("comment", F.lit(f" {suffix}"))).alias("comment"))

    own = F.struct(F.lit(0).alias("side"), F.col("content").alias("content"), F.col("comment").alias("comment"))
    splits = F.coalesce((F.size("_still") > 0) & (F.size("_moving") > 0), F.lit(False))
    out = F.when(splits, F.array(child(0, "_still", P.SPLIT_STATIC), child(1, "_moving", P.SPLIT_DYNAMIC))).otherwise(F.array(own))
    rows = rows.withColumn("_child", F.explode_outer(out)).withColumns({"content": F.col("_child.content"), "comment": F.col("_child.comment")})
    rows = rows.withColumn("_side", F.col("_child.side")).drop("_child", "_parts", "_still", "_moving", *[c for c in ANALYSIS if c in rows.columns])
    if by_ranges(E.complete(entries)) if ranges is None else ranges:
        rows = numbered(in_ranges(written(rows, "split"), [F.col("seq"), F.col("_side")], "split-sorted"), "rn")
    else:
        rows = E.ranked(rows, [F.col("seq"), F.col("_side")], ranges=False)
    at = F.col("rn")
    return rows.withColumns({"uid": at, "display_index": at, "seq": at}).drop("rn", "_side")


# Reorder


def reorder(entries: DataFrame, wrapper_name: str = P.WRAPPER_NAME, ranges: bool | None = None) -> DataFrame:
    """Stable text first: copies of boundaries around dynamic passages, a wrapper around all that moves, the six-key
    sort, pruning, renumbering and the field rules.

    One shuffle by book_id serves every window of the step, without joins.  With ranges (None: where a book is too large
    for one task) every order is laid out over all tasks instead.
    """
    if ranges is None:
        ranges = by_ranges(E.complete(entries))
    rows = E.complete(entries)
    rows = D.with_derived(written(rows, "unordered"), wrapper_name, True) if ranges else D.with_derived(rows.repartition("book_id"), wrapper_name)
    rows = rows.withColumns({"_copy_row": F.col("_batch") == 1, "_supp": F.col("_batch") == 2, "_static_text": T.is_static(F.col("content"))})
    keys = E.sort_keys(F.col("_static_text"), F.col("_copy_row"), F.col("_supp"))[:-1] + [F.col("_batch"), F.col("_tie")]
    if ranges:
        kept = E.renumbered(numbered(D.pruned_by_ranges(in_ranges(written(rows, "derived"), keys, "sorted")), "rn"))
    else:
        kept = D.pruned(E.ranked(rows, keys, ranges=False)).withColumnRenamed("rn", "_place")
        kept = E.renumbered(E.ranked(kept, [F.col("_place")], ranges=False)).drop("_place")
    kept = kept.withColumns(D.field_rules(F.col("_static_text"), F.col("_copy_row") | F.col("_supp")))
    return kept.drop("_copy_row", "_supp", "_pair", "_batch", "_tie", "_static_text")


# Merge


def mergeable(entries: DataFrame) -> Column:
    comment = F.col("comment")
    return ~E.is_outlet(F.col("position")) & ~F.col("disable") & ~T.is_copy(comment) & ~T.is_supplement(comment) & T.is_static(F.col("content"))


def merge(entries: DataFrame, ranges: bool | None = None) -> DataFrame:
    """Static entries of one position, constancy and depth become one: contents joined in order by blank lines, fields
    but position, constant, depth and role at their defaults.  Entries alone in their group stay as they are.

    Only contents are gathered; of the first entry's fields the least by order is kept, which combines on the map side.
    With ranges (None: where a book is too large for one task) a group is laid out in ranges over all tasks, each joins
    its own part of the text, and the group joins one text a range.  A merged text is one value, of 2 GB at most.
    """
    rows = E.complete(entries).withColumn("_can", mergeable(E.complete(entries)))
    if ranges is None:
        ranges = by_ranges(E.complete(entries))
    group = ["book_id", "position", "constant", "depth"]
    fields = [c for c in rows.columns if c not in (*group, "ord", "seq", "content", "_can")]
    low = F.struct("ord", "seq", *fields).alias("low")
    if ranges:
        rows = written(rows, "unmerged")
        can = in_ranges(rows.filter("_can"), [F.col(c) for c in (*group[1:], "ord", "seq")], "merge-sorted")
        facts = [F.min_by(low, "_at").alias("low"), F.max("ord").alias("high"), F.min("seq").alias("seen"), F.count(F.lit(1)).alias("n")]
        parts = can.groupBy(*group, "_range").agg(_joined_by("_at", "content").alias("part"), *facts)
        groups = parts.groupBy(group).agg(_joined_by("_range", "part").alias("content"), F.min_by("low", "_range").alias("low"), F.max("high").alias("high"), F.min("seen").alias("seen"), F.sum("n").alias("n"))
        alone = rows.filter("not _can").select(*group, "content", low, F.col("ord").alias("high"), F.col("seq").alias("seen"), F.lit(1).cast("bigint").alias("n"))
        groups = groups.withColumn("_batch", F.lit(0)).unionByName(alone.withColumn("_batch", F.lit(1)))
    else:
        at = F.struct("ord", "seq")
        keys = [*group, "_can", F.when(~F.col("_can"), F.col("seq")).alias("_alone")]
        facts = [F.min_by(low, at).alias("low"), F.max("ord").alias("high"), F.min("seq").alias("seen"), F.count(F.lit(1)).alias("n")]
        groups = rows.groupBy(keys).agg(_joined_by(at, "content").alias("content"), *facts).withColumn("_batch", F.when(F.col("_can"), 0).otherwise(1))
    several = F.col("n") > 1
    # What a merged entry has besides the fields of its group.
    merged = {
        "comment": F.concat(F.lit(P.MERGED), F.col("low.ord").cast("string"), F.lit("-"), F.col("high").cast("string")),
        "role": F.col("low.role"), "disable": F.lit(False), "key": F.array().cast("array<string>"), "probability": F.lit(100), "use_probability": F.lit(False),
        "sticky": F.lit(0), "cooldown": F.lit(0), "delay": F.lit(0),
    }
    out = [F.when(several, merged[c]).otherwise(F.col(f"low.{c}")).alias(c) if c in merged else F.when(~several, F.col(f"low.{c}")).alias(c) for c in fields]
    found = groups.select(*group, F.col("low.ord").alias("ord"), "content", *out, "_batch", F.col("seen").alias("_seen"))
    order = [F.col("ord"), F.col("_batch"), F.col("_seen")]
    found = placed(found, order, ranges=True)[0] if ranges else E.ranked(found, order, ranges=False)
    return E.renumbered(found).drop("_batch", "_seen")


def _joined_by(place: Column | str, text: str) -> Column:
    """Aggregate: the texts in order, joined by blank lines."""
    listed = F.array_sort(F.collect_list(F.struct(place if isinstance(place, str) else place.alias("at"), F.col(text).alias("text"))))
    return F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n")


def pipeline(entries: DataFrame, wrapper_name: str = P.WRAPPER_NAME, ranges: bool | None = None) -> DataFrame:
    if ranges is None:
        ranges = by_ranges(E.complete(entries))
    return merge(reorder(split(entries, ranges=ranges), wrapper_name, ranges), ranges)
