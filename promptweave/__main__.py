"""Command line: python -m promptweave COMMAND ...; reads books from JSON files (paths may hold patterns)."""

from __future__ import annotations

import argparse
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweave.functions import patterns as P
from promptweave.operators import entries as E
from promptweave.plans import lineage, pipeline, prompt, reports, validate
from promptweave.sources import artifacts, books
from promptweave.tables import written


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="promptweave", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, reads: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        if reads:
            p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", help="write the lines there instead of printing them")
        return p

    p = command("pipeline", "analyze, split, reorder and merge; writes <name>_<step>.json of each step for each book")
    p.add_argument("-d", "--output-dir", help="the input's folder if not given")
    p.add_argument("-w", "--wrapper-name", default=P.WRAPPER_NAME)
    p = command("list", "entries in sorted order")
    p.add_argument("--csv", action="store_true")
    p.add_argument("--filter", choices=["static", "dynamic"])
    p = command("list-full", "entries with a preview of their content")
    p.add_argument("--max-len", type=int, default=500)
    p.add_argument("--no-truncate", action="store_true")
    p.add_argument("--filter", choices=["static", "static-content", "dynamic"])
    p.add_argument("-u", "--uid", type=int)
    p.add_argument("-s", "--search")
    p = command("query", "filtered entries by order")
    p.add_argument("--filter", choices=["static", "dynamic", "boundary", "supplement", "merged"])
    p.add_argument("--order-range", type=int, nargs=2)
    p.add_argument("--search")
    p.add_argument("--csv", action="store_true")
    p.add_argument("--summary-only", action="store_true")
    p.add_argument("--verify", action="store_true")
    p = command("prompt", "the assembled prompt")
    for name in ("system-prompt", "character", "persona", "chat-history"):
        p.add_argument(f"--{name}", help="a file")
    p.add_argument("--scenario")
    p.add_argument("-C", "--no-comments", action="store_true")
    p = command("validate", "findings and totals", reads=False)
    p.add_argument("-i", "--input")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--pipeline-check", action="store_true", help="rules on a step's result instead")
    p.add_argument("--pipeline-dir", help="check the chains of files in this folder")
    p.add_argument("--pipeline-name", help="only the chain of this book")
    p.add_argument("--output-errors", help="write the findings there, a JSON document a book")
    p = command("diff", "where entries went", reads=False)
    p.add_argument("--original", required=True)
    p.add_argument("--optimized", required=True)
    p.add_argument("--from-uid", type=int, nargs="*")
    p.add_argument("--from-search")
    p.add_argument("--to-uid", type=int, nargs="*")
    p.add_argument("--to-search")
    p.add_argument("--summary", action="store_true")
    p.add_argument("-f", "--format", choices=["unified", "json"], default="unified")
    p.add_argument("--max-order-changes", type=int, default=0, help="accepted for compatibility; all changes of order are told")
    return top


def _file(spark: SparkSession, path: str | None) -> str | None:
    return None if path is None else spark.read.text(path, wholetext=True).first()["value"]


def _json(df: DataFrame, *order: str) -> DataFrame:
    return df.select(*order, F.to_json(F.struct(*df.columns)).alias("line"))


def _chosen(rows: DataFrame, uids: list[int] | None, search: str | None) -> DataFrame:
    rows = E.complete(rows)
    if uids:
        rows = E.by_uid(rows, uids)
    return E.by_search(rows, search, any_case=True) if search else rows


def _ordered(lines: DataFrame, book: str = "book_id") -> DataFrame:
    return lines.orderBy(book, "part", "rn")


def _diff(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    # One book against its other form: both are the same book, whatever their files are called.
    old, new = (books.read_books(spark, path).withColumn("book_id", F.lit(0).cast("bigint")) for path in (args.original, args.optimized))
    names = tuple(os.path.basename(x) for x in (args.original, args.optimized))
    if args.from_uid or args.from_search:
        wanted = _chosen(old, args.from_uid, args.from_search).select("book_id", F.col("uid").alias("orig_uid"))
        return _ordered(reports.forward_tree(old, new, names, wanted))
    if args.to_uid or args.to_search:
        wanted = _chosen(new, args.to_uid, args.to_search).select("book_id", F.col("uid").alias("opt_uid"))
        return _ordered(reports.reverse_tree(old, new, names, wanted))
    if args.summary:
        return _json(lineage.summary(old, new))
    raw = books.raw_books(spark, args.original)
    removed = raw.filter(F.array_contains(F.json_object_keys("value"), "originalData")).select(F.lit(0).cast("bigint").alias("book_id"), F.lit("originalData").alias("name"))
    if args.format == "json":
        return reports.diff_document(old, new, (args.original, args.optimized), removed).select(F.col("document").alias("line"))
    return _ordered(reports.diff_report(old, new, names, removed))


def _run_steps(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The four steps with a file for each step and book; the originals are backed up first."""
    folder = args.output_dir or os.path.dirname(args.input) or "."
    artifacts.backup(spark, args.input)
    found = artifacts.named_books(spark, args.input)
    names = found.select("book_id", "stem")
    rows, told = books.parse_books(found), []

    def done(step: str, n: int) -> None:
        told.append(f"[{len(told) + 1}/{len(artifacts.STEPS)}] {step}: {n} files in {folder}")

    analyzed = pipeline.analyze(rows).select("book_id", "seq", "uid", "comment", *pipeline.ANALYSIS)
    texts = names.join(artifacts.analysis_json(analyzed, names), "book_id").select(F.concat("stem", F.lit("_analysis.json")).alias("name"), "value")
    done("analysis", artifacts.write_files(texts, folder))
    # Each step is written once and the next reads what was written, so that none runs twice.
    split = written(pipeline.split(rows), "split")
    done("split", artifacts.write_books(split, names, folder, "split"))
    reordered = written(pipeline.reorder(split, args.wrapper_name), "reordered")
    done("reordered", artifacts.write_books(reordered, names, folder, "reordered"))
    done("merged", artifacts.write_books(pipeline.merge(reordered), names, folder, "merged"))
    return told


def _validated(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(report lines, a JSON document a book) of a validation."""
    if args.pipeline_dir:
        names = spark.createDataFrame([(args.pipeline_name,)], "stem string") if args.pipeline_name else None
        missing, counts, kept = artifacts.chain_of_files(spark, args.pipeline_dir, names)
        names = names if names is not None else missing.select("stem").unionByName(counts.select("stem")).distinct()
        found = validate.check_files(missing, counts, kept, names)
        sources = names.select(F.col("stem").alias("book_id"), F.col("stem").alias("source"))
        return _ordered(reports.chain_report(found, counts, kept, names, artifacts.STEPS), "stem"), reports.validation_document(found.withColumnRenamed("stem", "book_id"), sources)
    absent = artifacts.missing_paths(spark, [args.input]).select(F.xxhash64("path").alias("book_id"), F.col("path").alias("source"))
    found = validate.finding(absent, "A0", "error", "file", F.concat(F.lit("File not found: "), "source"))
    if not absent.isEmpty():
        return _ordered(reports.validation_report(found, absent)), reports.validation_document(found, absent)
    named = artifacts.named_books(spark, args.input)
    sources = named.select("book_id", artifacts.name_of(F.col("path")).alias("source"))
    rows = books.parse_books(named)
    if args.pipeline_check:
        found = validate.check_artifact(rows).unionByName(validate.missing_books(sources.select("book_id"), rows))
    else:
        found = validate.validate(rows, args.strict).unionByName(_damaged(spark, args.input))
    return _ordered(reports.validation_report(found, sources)), reports.validation_document(found, sources)


def lines_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The command's result as ordered lines, the column `line`."""
    if args.command == "diff":
        return _diff(spark, args)
    if args.command == "validate":
        report, documents = _validated(spark, args)
        if args.output_errors:
            documents.select(F.col("document").alias("line")).coalesce(1).write.mode("overwrite").text(args.output_errors)
        return report
    if args.command == "pipeline":
        return spark.createDataFrame([(x,) for x in _run_steps(spark, args)], "line string")
    rows = books.read_books(spark, args.input)
    if args.command == "list":
        return _ordered(reports.list_report(rows, None if args.filter is None else args.filter == "static", args.csv))
    if args.command == "list-full":
        return _ordered(reports.full_report(rows, None if args.filter is None else args.filter != "dynamic", args.uid, args.search, None if args.no_truncate else args.max_len))
    if args.command == "query":
        order_range = tuple(args.order_range) if args.order_range else None
        if args.verify:
            return _ordered(reports.verify_report(rows, books.raw_books(spark, args.input).select(F.xxhash64("path").alias("book_id"))))
        if args.summary_only:
            return _ordered(reports.summary_report(rows, args.filter, order_range, args.search))
        return _ordered(reports.query_report(rows, args.filter, order_range, args.search, args.csv))
    every = rows.select("book_id").distinct()
    chat, card = (_file(spark, x) for x in (args.chat_history, args.character))
    parts = prompt.sections(
        rows,
        chat=books.chat_messages(every.withColumn("value", F.lit(chat))) if chat is not None else None,
        system=_file(spark, args.system_prompt),
        persona=_file(spark, args.persona),
        scenario=args.scenario,
        card=books.character_card(every.withColumn("value", F.lit(card))) if card is not None else None,
        comments=not args.no_comments,
    )
    return prompt.prompt_text(parts).select("book_id", F.col("text").alias("line")).orderBy("book_id")


def _damaged(spark: SparkSession, path: str) -> DataFrame:
    found = books.damaged_books(spark, path).filter(~F.contains("path", F.lit(artifacts.BACKUP)))
    said = F.when(F.col("code") == "A1", F.concat(F.lit("Invalid JSON: "), "path")).otherwise("entries is not a dict")
    return found.select(F.xxhash64("path").alias("book_id"), "code", F.lit("error").alias("level"), F.lit("file").alias("scope"), F.lit(None).cast("bigint").alias("uid"), said.alias("message"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Iterable[str]:
    """Runs a command; yields its lines unless they are written to a file."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("promptweave").getOrCreate()
    found = lines_of(spark, args)
    if args.output:
        # The lines' order is the report, so it is one file.
        found.select("line").coalesce(1).write.mode("overwrite").text(args.output)
        return
    for row in found.select("line").toLocalIterator():
        yield row["line"]


if __name__ == "__main__":
    for line in main():
        print(line)
