"""Substring dedup: word windows as edges of a De Bruijn graph, compacted into nonbranching paths that Spark joins.

A window of WINDOW words is an edge.  Walking a document, neighbouring edges that share a minimizer (the KMER words of
least hash among those in the window, so a function of the window alone) form a path; equal windows always lie in
paths of one minimizer.  Equal paths of several documents are joined as a whole; only under a minimizer with differing
paths, a branch, are single edges compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, read_table, saved, small_batches

WINDOW = 50
KMER = 16
#: Words that are hashed at a time; a longer document is one block of its own.
BLOCK_WORDS = 400_000
#: Bits of the map of documents that are a source.
MAP_BITS = 1 << 23
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: powers differ in all but few low bits
_INVERSE = pow(_BASE, -1, 1 << 64)
_CACHE = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes, of 64 bits if not asked for fewer, of runs of words in a list of documents, each run in constant time."""

    def __init__(self, bits: int = 64) -> None:
        self.spare = np.uint64(64 - bits)
        self.known: dict[bytes, int] = {}
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n >= len(self.power):
            size = max(n + 1, 2 * len(self.power))
            steps = np.full(size, _BASE, np.uint64)
            back = np.full(size, _INVERSE, np.uint64)
            steps[0] = back[0] = 1
            self.power, self.inverse = np.multiply.accumulate(steps), np.multiply.accumulate(back)

    def load(self, words: list[bytes]) -> None:
        if len(self.known) > _CACHE:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        values = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w, 17)
            values.append(h)
        codes = np.array(values, np.uint64)
        self._powers(len(words))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * self.power[: len(words)], dtype=np.uint64)))

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64)) >> self.spare


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value among the `width` from each place on."""
    at, span = np.arange(len(values)), 1
    low = values
    while span < width:
        step = min(span, width - span)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        span += step
    return at


def paths(hasher: Hasher, lengths: np.ndarray, window: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Paths of the loaded documents: document's index, first and last window, minimizer hash, content hash."""
    total = int(lengths.sum())
    if total < window:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(total - kmer + 1)
    marks = hasher.runs(place, place + kmer)
    least = _least_of(marks, window - kmer + 1)
    inside = doc[: total - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    fresh = np.concatenate(([True], (np.diff(least[at]) != 0) | (np.diff(at) != 1)))
    first = at[fresh]
    last = at[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(at) - 1]))]
    return doc[first], first, last, marks[least[first]], hasher.runs(first, last + window)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Rows of a batch in blocks of about BLOCK_WORDS words: row numbers and their words."""
    rows, texts, size = [], [], 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        words = (text or "").encode("utf-8", "surrogatepass").split()  # on bytes: blank, \t, \n, \v, \f, \r
        if size and size + len(words) > BLOCK_WORDS:
            yield rows, texts
            rows, texts, size = [], [], 0
        rows.append(i)
        texts.append(words)
        size += len(words)
    if rows:
        yield rows, texts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _path_batches(window: int, kmer: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in batches:
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "twin"))
            for rows, texts in _blocks(batch):
                lengths = np.array([len(t) for t in texts])
                hasher.load([w for t in texts for w in t])
                doc, first, last, mark, content = paths(hasher, lengths, window, kmer)
                base = np.concatenate(([0], np.cumsum(lengths)))[doc]
                own = np.array(rows)[doc]
                cols = [_signed(mark), _signed(content), pa.array(ids[own].astype(np.int64)), pa.array(twins[own].astype(np.int64)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["mark", "content", "doc_id", "twin", "first", "last"])

    return run


def _edge_batches(window: int, bits: int):
    """Rows with text and `at`, the paths to take apart: a row for each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in batches:
            ids, twins, at = (batch.column(c).to_pylist() for c in ("doc_id", "twin", "at"))
            for rows, texts in _blocks(batch):
                hasher.load([w for t in texts for w in t])
                base, starts, marks, docs = 0, [], [], []
                for i, t in zip(rows, texts):
                    for p in at[i]:
                        n = min(p["last"], len(t) - window) - p["first"] + 1
                        if n <= 0:
                            continue
                        starts.append(np.arange(base + p["first"], base + p["first"] + n))
                        marks.append(np.full(n, p["mark"], np.int64))
                        docs.append(np.stack((np.full(n, ids[i], np.int64), np.full(n, twins[i], np.int64), np.arange(p["first"], p["first"] + n)), axis=1))
                    base += len(t)
                if not starts:
                    continue
                start, who = np.concatenate(starts), np.concatenate(docs)
                cols = [pa.array(np.concatenate(marks)), _signed(hasher.runs(start, start + window)), pa.array(who[:, 0].copy()), pa.array(who[:, 1].copy()), pa.array(who[:, 2].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["mark", "content", "doc_id", "twin", "first"])

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _lists(column: pa.Array, *names: str) -> Iterator[list]:
    """Of each row of an array<struct> the fields' values, a row at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    valid = column.is_valid().to_pylist()
    fields = [column.values.field(n) for n in names]
    for ok, i, j in zip(valid, ends, ends[1:]):
        yield [f.slice(i, j - i if ok else 0) for f in fields]


def _source_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with text and `asked`, places (t, n) in it: the digest of the words that stand there."""
    for batch in batches:
        rows = []
        for doc_id, twin, text, (at, size) in zip(batch.column("doc_id").to_pylist(), batch.column("twin").to_pylist(), batch.column("text"), _lists(batch.column("asked"), "t", "n")):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            rows += [(doc_id, twin, t, n, _digest(words[t : t + n])) for t, n in zip(at.to_pylist(), size.to_pylist())]
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["source", "source_twin", "t", "n", "digest"])


def _cut_text(words: list[bytes], start: pa.Array, end: pa.Array, digests: pa.Array) -> tuple[int, bytes]:
    """The number of words that spans cover, and the rest.  A span whose words are not the source's covers none."""
    gone = np.zeros(len(words) + 1, np.int64)
    known: dict[tuple[int, int], bytes] = {}
    for s, e, d in zip(start.to_pylist(), end.to_pylist(), digests):
        if e > len(words):
            continue
        own = known.get((s, e))
        if own is None:
            own = known[(s, e)] = _digest(words[s:e])
        if own in d.as_py():
            gone[s] += 1
            gone[e] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    return int(covered.sum()), b" ".join(w for w, c in zip(words, covered.tolist()) if not c)


def _keep_batches(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), _lists(batch.column("spans"), "s", "e", "digests")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n, kept = _cut_text(words, *spans)
                rows.append((len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None))
            n_words, n_gone, sha, kept = zip(*rows) if rows else ((), (), (), ())
            cols = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols.append(pa.array(kept, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _repeated(rows: DataFrame, texts: DataFrame, window: int, bits: int) -> DataFrame:
    """rows: all paths.  Spans (doc_id, twin, s, e, source, source_twin, t) of words under windows that start in the
    smaller doc_id source too, at its word t; twin, a hash of the text, tells texts under one doc_id apart."""
    # Minimizers of two documents or more; all others are done with.  Aggregates are written before they are joined:
    # then both sides of each join come straight from a shuffle, and Spark splits a hot key's partition.
    at = F.min(F.struct("doc_id", "twin", "first"))
    its = [F.col("at.doc_id").alias("source"), F.col("at.twin").alias("source_twin"), F.col("at.first").alias("t")]
    span = ["doc_id", "twin", "s", "e", "source", "source_twin", "t"]
    shared = saved(rows.groupBy("mark").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("mark"), "shared")
    met = saved(rows.join(shared, "mark"), "paths")
    dropped(rows, shared)
    sources = saved(met.groupBy("mark", "content").agg(at.alias("at")).select("mark", "content", *its), "sources")
    branches = saved(sources.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark"), "branches")
    told = met.join(sources, ["mark", "content"])
    whole = told.filter("source < doc_id").withColumns({"s": F.col("first"), "e": F.col("last") + window}).select(span)
    # The first document of a path may share some of the path's edges with others at a branch: take it apart.
    open_paths = told.filter("source = doc_id").join(branches, "mark")
    parts = open_paths.groupBy(F.col("doc_id").alias("id"), F.col("twin").alias("other")).agg(F.collect_list(F.struct("mark", "first", "last")).alias("at"))
    edges = texts.join(parts, (F.col("doc_id") == F.col("id")) & (F.col("twin") == F.col("other")), "left").filter("at is not null").select("doc_id", "twin", "text", "at")
    edges = saved(edges.mapInArrow(_edge_batches(window, bits), "mark long, content long, doc_id long, twin long, first int"), "edges")
    first_of = edges.groupBy("mark", "content").agg(at.alias("at"), F.max("doc_id").alias("high")).filter("at.doc_id < high")
    first_of = saved(first_of.select("mark", "content", *its), "first-edges")
    single = edges.join(first_of, ["mark", "content"]).filter("source < doc_id")
    single = single.withColumns({"s": F.col("first"), "e": F.col("first") + window}).select(span)
    spans = saved(_joined(whole.unionByName(single)), "spans")
    dropped(met, sources, branches, edges, first_of)
    return spans


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of one text that stand as far apart in one source, where they touch, as one: a run of edges becomes one
    path again."""
    ends = ["doc_id", "twin", "source", "source_twin"]
    line = Window.partitionBy(*ends, F.col("s") - F.col("t")).orderBy("s", "e")
    before = F.max("e").over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("s") <= before, 0).otherwise(1)
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*ends, (F.col("s") - F.col("t")).alias("off"), "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return found.select("doc_id", "twin", "s", "e", "source", "source_twin", (F.col("s") - F.col("off")).alias("t"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, bits: int = 64) -> DataFrame:
    """doc_id, twin, s, e, source, source_twin, t: runs of words s .. e - 1 of a document that by their hashes stand in the document source
    as well, from its word t on; source has the smallest id of all that hold them.  Runs of one document may overlap.
    The twins are hashes of the texts that the places are in.  Null ids and texts have none."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text", _twin())
    rows = texts.filter("doc_id is not null").mapInArrow(_path_batches(window, kmer, bits), "mark long, content long, doc_id long, twin long, first int, last int")
    return _repeated(saved(rows, "all-paths"), texts, window, bits)


def _twin() -> Column:
    return F.xxhash64("text").alias("twin")


def verifiable(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans with digests: of the words at the source's coordinates, read from the source's text.  Whoever removes a span compares them with its own words.

    Each place of a source is read once, however many documents repeat it, and only texts that are a source are dealt.
    """
    place = ["source", "source_twin", "t", "n"]
    asked = spans.select("source", "source_twin", "t", (F.col("e") - F.col("s")).alias("n")).distinct()
    parts = asked.groupBy("source", "source_twin").agg(F.collect_list(F.struct("t", "n")).alias("asked"))
    read = texts_of(docs, spans.select(F.col("source").alias("doc_id"))).withColumn("twin", _twin())
    read = read.join(parts, (F.col("doc_id") == F.col("source")) & (F.col("twin") == F.col("source_twin"))).select("doc_id", "twin", "text", "asked")
    digests = read.mapInArrow(_source_batches, "source long, source_twin long, t int, n int, digest binary").groupBy(place).agg(F.collect_set("digest").alias("digests"))
    digests = saved(digests, "digests")
    there = (F.col("spans.source") == F.col("d.source")) & (F.col("spans.source_twin") == F.col("d.source_twin")) & (F.col("spans.t") == F.col("d.t")) & (F.col("e") - F.col("s") == F.col("d.n"))
    return spans.alias("spans").join(digests.alias("d"), there).select("spans.*", "d.digests")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows with one of the ids, and a few more: a map of bits of a fixed size spares most others
    the shuffle."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    bits = ids.select(F.shiftright(place, 15).alias("k"), place.bitwiseAND(32767).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    cells = docs.select("doc_id", "text", F.shiftright(place, 15).alias("k"), place.bitwiseAND(32767).alias("p"))
    # At most MAP_BITS / 2^15 rows of 4 KB.
    met = cells.join(F.broadcast(bits.withColumnRenamed("k", "k2")), F.col("k") == F.col("k2"))
    return met.filter("getbit(cast(conv(hex(substring(bits, cast(p div 8 as int) + 1, 1)), 16, 10) as int), cast(p % 8 as int)) = 1").select("doc_id", "text")


def without_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, keep_text: bool = True, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept.

    Words are runs of characters other than blank and 0x09-0x0D.  A word is removed where it is covered by a window of
    `window` words that also starts in a document with a smaller doc_id; windows are judged on the input.  kept is the
    words left, joined by one blank.  Null and empty texts have no words; texts shorter than a window stay whole; a
    null doc_id is neither smaller nor larger than another, so its row stays whole; rows repeated under one doc_id are
    no smaller than each other and are each returned; an empty table gives no rows.

    Windows meet by two hashes, of the minimizer and of the whole content; then each span is verified: its words'
    digest is compared with that of the words at the source's coordinates.  Per window only those at branches move;
    per path 32 bytes; every grouping is a minimum that combines on the map side, so a passage that a third of the
    corpus shares stays one row per task.
    """
    texts = docs.select("doc_id", "text", _twin())
    spans = verifiable(repeated_spans(docs, window, kmer, bits), docs)
    spans = spans.groupBy(F.col("doc_id").alias("id"), F.col("twin").alias("other")).agg(F.collect_list(F.struct("s", "e", "digests")).alias("spans"))
    joined = texts.join(spans, (F.col("doc_id") == F.col("id")) & (F.col("twin") == F.col("other")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_keep_batches(keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents"), keep_text=False)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)
), m AS (
  SELECT h, min(doc_id) AS low FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM g JOIN m USING (h) WHERE low < doc_id
), gone AS (
  SELECT doc_id, list(i) AS gone, count(*) AS n FROM c GROUP BY doc_id
), u AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN c USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN k USING (doc_id)
"""
