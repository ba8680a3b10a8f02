"""Books as files by name: one JSON file for each book and step, backups, and the check of a chain of such files.

Files are written by tasks into a staged folder beside their place and then moved there, each whole and over what was
there before: a run that fails leaves the old files as they are, and one that is repeated ends what was begun.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweave.sources import books as S
from promptweave.tables import hadoop

# The steps in order, and how their files and backups are named.
STEPS = ["analysis", "split", "reordered", "merged"]
BACKUP = ".backup_"


def name_of(path: Column) -> Column:
    """The last part of a path as input_file_name tells it, that is, encoded."""
    return F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))


def stem_of(name: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def named_books(spark: SparkSession, path: str) -> DataFrame:
    """book_id, path, stem, value of all book files under path, backups left out."""
    rows = S.raw_books(spark, path).withColumn("name", name_of(F.col("path"))).filter(~F.contains("name", F.lit(BACKUP)))
    return rows.select(F.xxhash64("path").alias("book_id"), "path", stem_of(F.col("name")).alias("stem"), "value")


def missing_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, code (A0) of paths, which may be patterns, that no file has."""
    absent = []
    for p in paths:
        system, target = hadoop(spark, p)
        if not (system.globStatus(target) or []):
            absent.append((p, "A0"))
    return spark.createDataFrame(absent, "path string, code string")


def write_files(texts: DataFrame, folder: str) -> int:
    """texts (name, value): the file `name` in folder for each row, its value and a line end in it; returns how many.

    No two rows may have one name.  The files' names pass through the driver, their texts do not.
    """
    spark, staged = texts.sparkSession, f"{folder.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    twice = [r["name"] for r in texts.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect()]
    if twice:
        raise ValueError(f"several texts for one file: {', '.join(map(str, twice))}")
    system, place = hadoop(spark, staged)
    system.deleteOnExit(place)
    n = 0
    try:
        texts.select("name", "value").write.partitionBy("name").text(staged)
        jvm = spark.sparkContext._jvm
        over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        for part in system.listStatus(place):
            if part.isDirectory():
                name = unquote(part.getPath().getName().split("=", 1)[1])
                for file in system.listStatus(part.getPath()):
                    if file.getPath().getName().startswith("part-"):
                        context.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}"), over)
                        # A local file system keeps checksums beside; without them the files may be edited by other tools.
                        system.delete(jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/.{name}.crc"), False)
                        n += 1
    finally:
        system.delete(place, True)
    return n


def write_books(entries: DataFrame, names: DataFrame, folder: str, step: str) -> int:
    """A file `<stem>_<step>.json` for each book of names (book_id, stem), empty ones included."""
    texts = names.join(S.book_json(entries), "book_id", "left")
    name = F.concat("stem", F.lit(S.artifact_name("", step) + ".json"))
    return write_files(texts.select(name.alias("name"), F.coalesce("value", F.lit('{"entries":{}}')).alias("value")), folder)


def analysis_json(analyzed: DataFrame, names: DataFrame) -> DataFrame:
    """book_id, value: a book's analysis as one document: source, generated_at, entries, summary."""
    ranges = F.when(F.col("is_mixed") & (F.size("ranges") > 0), F.transform("ranges", lambda r: F.array(r["s"], r["e"])))
    entry = F.struct(
        "uid", "comment", "is_static", "is_mixed", F.col("markers").alias("detected_markers"), "suggested_split", ranges.alias("ejs_compound_ranges"), F.col("boundaries").alias("split_boundaries")
    )
    rows = analyzed.groupBy("book_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.to_json(entry, {"ignoreNullFields": "false"}).alias("json")))).alias("all"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_static").alias("static"),
        F.count_if(~F.col("is_static") & ~F.col("is_mixed")).alias("dynamic"),
        F.count_if("is_mixed").alias("mixed"),
    )
    rows = names.join(rows, "book_id", "left").fillna(0, ["total", "static", "dynamic", "mixed"])
    listed = F.array_join(F.transform(F.coalesce("all", F.array().cast("array<struct<seq:bigint,json:string>>")), lambda x: x["json"]), ",")
    head = F.to_json(F.struct(F.concat("stem", F.lit(".json")).alias("source"), F.current_timestamp().cast("string").alias("generated_at")))
    summary = F.to_json(F.struct("total", "static", "dynamic", "mixed"))
    value = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"entries":['), "listed", F.lit('],"summary":'), "summary", F.lit("}"))
    return rows.withColumns({"head": head, "listed": listed, "summary": summary}).select("book_id", value.alias("value"))


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """stem, seq and the fields of the entries of analysis files."""
    boundary = "struct<level:int,heading:string,start_line:int,end_line:int,is_dynamic:boolean,wrap_tag:string>"
    kind = f"entries array<struct<uid:bigint,comment:string,is_static:boolean,is_mixed:boolean,detected_markers:array<string>,suggested_split:boolean,ejs_compound_ranges:array<array<int>>,split_boundaries:array<{boundary}>>>"
    rows = S.raw_books(spark, path).select(F.regexp_replace(stem_of(name_of(F.col("path"))), "_analysis$", "").alias("stem"), F.posexplode(F.from_json("value", kind)["entries"]).alias("seq", "e"))
    return rows.select("stem", F.col("seq").cast("bigint").alias("seq"), "e.*")


def read_artifacts(spark: SparkSession, folder: str, step: str) -> DataFrame:
    """stem and the entries of a step's files in folder; book_id is a hash of the stem."""
    rows = S.raw_books(spark, f"{folder.rstrip('/')}/*_{step}.json")
    rows = rows.select(F.regexp_replace(name_of(F.col("path")), rf"_{step}\.json$", "").alias("stem"), "value").withColumn("book_id", F.xxhash64("stem"))
    return S.parse_books(rows).join(rows.select("book_id", "stem"), "book_id")


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """name, length of the files in a folder; their contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("name"), "length")  # this path is as it is


def is_product(stem: Column) -> Column:
    return F.regexp_like(stem, F.lit(f"_({'|'.join(STEPS)})$"))


def backup(spark: SparkSession, path: str) -> int:
    """Copies every original book under path to `<stem>.backup_<time><extension>` in its folder; returns how many.

    Products of the steps and backups are not copied, nor is a book that has a backup of the same content, as a run that
    failed leaves it.  A manifest of the copies (source, backup, bytes, md5) is written beside them, in
    `.backup-manifests/<time>`, once they are all there.  A copy ends with a line end.
    """
    stamp = time.strftime("%Y%m%d_%H%M%S")
    rows = S.raw_books(spark, path).withColumns({"name": name_of(F.col("path")), "folder": F.regexp_replace("path", "/[^/]*$", ""), "body": F.regexp_replace("value", r"\n\z", "")})
    rows = rows.withColumns({"stem": stem_of(F.col("name")), "md5": F.md5(F.col("body").cast("binary"))}).filter(~F.contains("name", F.lit(BACKUP))).filter(~is_product(F.col("stem")))
    n = 0
    for folder in [unquote(r["folder"]) for r in rows.select("folder").distinct().collect()]:
        own = rows.filter(F.url_decode(F.replace("folder", F.lit("+"), F.lit("%2B"))) == folder)
        system, pattern = hadoop(spark, f"{folder}/*{BACKUP}*")
        if system.globStatus(pattern):
            kept = S.raw_books(spark, f"{folder}/*{BACKUP}*").withColumn("name", name_of(F.col("path")))
            kept = kept.select(F.regexp_extract("name", r"^(.*?)\.backup_", 1).alias("stem"), F.md5(F.regexp_replace("value", r"\n\z", "").cast("binary")).alias("md5")).distinct()
            own = own.join(kept, ["stem", "md5"], "left_anti")
        own = own.withColumn("backup", F.concat("stem", F.lit(f"{BACKUP}{stamp}"), F.expr("substring(name, length(stem) + 1)")))
        told = own.select(F.col("name").alias("source"), "backup", F.length(F.col("body").cast("binary")).alias("bytes"), "md5").collect()  # a row for each file, no text
        if told:
            n += write_files(own.select(F.col("backup").alias("name"), F.col("body").alias("value")), folder)
            spark.createDataFrame(told).coalesce(1).write.mode("overwrite").json(f"{folder}/.backup-manifests/{stamp}")
    return n


def chain_of_files(spark: SparkSession, folder: str, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(missing, counts, backups) of the chains in a folder, for names (stem) or all that have any product there.

    missing: stem, name of the products that are not there; counts: stem, step, n, the entries of the others, 0 where
    they are neither a map nor a list; backups: stem, name.  Listing reads no contents, and joins are on equal keys.
    """
    here = files_in(spark, folder).select("name")
    shape = rf"^(.*)_({'|'.join(STEPS)})\.json$"
    products = here.select("name", F.regexp_extract("name", shape, 1).alias("stem"), F.regexp_extract("name", shape, 2).alias("step")).filter("step <> ''")
    names = products.select("stem").distinct() if names is None else names.select("stem").distinct()
    wanted = names.select("stem", F.explode(F.array(*map(F.lit, STEPS))).alias("step")).withColumn("name", F.concat("stem", F.lit("_"), "step", F.lit(".json")))
    missing = wanted.join(products.select("name"), "name", "left_anti").select("stem", "name")
    kind = F.coalesce(F.size(F.map_keys(F.from_json("value", "entries map<string,string>")["entries"])), F.size(F.from_json("value", "entries array<string>")["entries"]), F.lit(0))
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(name_of(F.input_file_name()).alias("name"), "value")
    counts = wanted.join(texts, "name").select("stem", "step", F.greatest(kind, F.lit(0)).cast("bigint").alias("n"))
    backups = here.select(F.regexp_extract("name", r"^(.*?)\.backup_", 1).alias("stem"), "name").filter("stem <> ''").join(names, "stem", "left_semi")
    return missing, counts, backups
