"""Ranked lexical search over a bit-sliced impact index.

Documents lie in blocks of bounded size.  In a block, a term has one bitmap for each bit of its impact: bit b of place p
tells whether bit b of the impact on document p is set.  The scores of a query are the sums of its terms' bitmaps, added
slice by slice with carries, for all documents of a block at once; the best are found from the most significant slice
down.  Impacts are exact integers, so the sums are the scores themselves.

Defined results: a null, empty or term-less text is no document (it counts in no statistic and is never found); rows
repeated under one doc_id are documents of their own; a null doc_id ranks after all others of its score.  Items without
terms find nothing; repeated rows of one item count once, different texts under one item_id are ranked each for itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, saved, small_batches

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
TOP = 10
#: Most documents and postings of one block: bounds the bitmaps and what a task holds of a block.
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 20
#: Most term occurrences of the items searched in one pass over the documents: bounds what is broadcast.
PASS_TERMS = 1 << 19
#: Terms with up to so many documents in a block set their bits one by one.
_FEW = 12
_LONG = 1 << 20

_BLOCK = "n_docs long, n_terms long, ids array<long>, sizes binary, terms array<string>, dfs array<int>, places binary, tfs binary"


def counted(text: str | None) -> tuple[int, Counter]:
    """Occurrences of all terms of a text, and of each; only A-Z is lower-cased."""
    if not text:
        return 0, Counter()
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # on bytes, lower() knows ASCII only
    if len(text) < _LONG:
        found = TERM.findall(text)
        return len(found), Counter(found)
    counts = Counter(m.group() for m in TERM.finditer(text))
    return counts.total(), counts


# The index


class _Filling:
    """A block while documents are added."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.held: dict[str, list[tuple[int, int]]] = {}
        self.n_docs = self.n_terms = self.n_postings = 0

    def add(self, doc_id: int | None, n: int, counts: dict[str, int]) -> None:
        self.n_docs += 1
        self.n_terms += n
        if counts:
            place = len(self.ids)
            self.ids.append(doc_id)
            self.sizes.append(n)
            self.n_postings += len(counts)
            for term, tf in counts.items():
                self.held.setdefault(term, []).append((place, tf))

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.n_postings >= BLOCK_POSTINGS

    def row(self) -> dict:
        """Places follow the doc_ids, null last, so that of equal scores the lower places win."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        flat = np.array([x for pairs in self.held.values() for x in pairs], np.int64).reshape(-1, 2)
        return {
            "n_docs": self.n_docs, "n_terms": self.n_terms, "ids": [self.ids[i] for i in order], "sizes": np.array([self.sizes[i] for i in order], np.int64).tobytes(),
            "terms": list(self.held), "dfs": [len(x) for x in self.held.values()], "places": place[flat[:, 0]].tobytes(), "tfs": flat[:, 1].tobytes(),
        }


_ARROW = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32())), ("places", pa.binary()), ("tfs", pa.binary())])


def index_blocks(docs: DataFrame, asked) -> DataFrame:
    """The index of the terms in `asked` (a broadcast set) over all documents: a row per block, written by each task for
    the documents it reads, so nothing is shuffled.  The rows also count the documents and terms of the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, block = asked.value, _Filling()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, counts = counted(text)
                if n:
                    block.add(doc_id, n, {t: counts[t] for t in counts.keys() & wanted})
                if block.full():
                    yield pa.RecordBatch.from_pylist([block.row()], _ARROW)
                    block = _Filling()
        if block.n_docs:
            yield pa.RecordBatch.from_pylist([block.row()], _ARROW)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def slices(places: np.ndarray, values: np.ndarray) -> list[int]:
    """Bitmaps of the bits of values, least significant first; bit p of each is of the document at place p."""
    bits = int(values.max()).bit_length() if len(values) else 0
    if len(values) <= _FEW:
        out = [0] * bits
        for p, v in zip(places.tolist(), values.tolist(), strict=True):
            for b in range(v.bit_length()):
                out[b] |= (v >> b & 1) << p
        return out
    table = np.zeros((bits, int(places.max()) + 1), np.uint8)
    table[:, places] = (values >> np.arange(bits)[:, None]) & 1
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(table, axis=1, bitorder="little")]


class Block:
    """A block of the index, opened with the statistics of the whole table: its terms' impacts as bit slices."""

    def __init__(self, row: dict, weights: dict[str, int], n_docs: int, n_terms: int) -> None:
        self.ids, self.weights, self.cut = row["ids"], weights, {}
        places, tfs = np.frombuffer(row["places"], np.int32), np.frombuffer(row["tfs"], np.int64)
        # Of any size, as Python's integers are: 75 * n * N may pass 64 bits.
        norms = np.array([8 * (25 + 75 * n * n_docs // n_terms) for n in np.frombuffer(row["sizes"], np.int64).tolist()], np.int64)
        self.places, self.parts = places, 1_000_000_000 * tfs // (1000 * tfs + norms[places])
        ends = np.cumsum(row["dfs"], dtype=np.int64).tolist()
        self.at = {t: (z - n, z) for t, n, z in zip(row["terms"], row["dfs"], ends, strict=True)}

    def impacts(self, term: str, times: int) -> list[int]:
        """Slices of a term that an item holds so many times."""
        found = self.cut.get((term, times))
        if found is None:
            a, z = self.at[term]
            found = self.cut[term, times] = slices(self.places[a:z], self.parts[a:z] * (self.weights[term] * times))
        return found

    def scores(self, terms: list[tuple[str, int]]) -> list[int]:
        """Slices of the sums of the terms' impacts."""
        total: list[int] = []
        for term, times in terms:
            if term in self.at:
                total = added(total, self.impacts(term, times))
        return total


def added(a: list[int], b: list[int]) -> list[int]:
    """Slices of the sums of two sliced columns: a full adder for each bit, over all documents at once."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], 0
    for i, x in enumerate(a):
        if i < len(b):
            y = b[i]
            half = x ^ y
            out.append(half ^ carry)
            carry = x & y | half & carry
        elif carry:
            out.append(x ^ carry)
            carry &= x
        else:
            out.extend(a[i:])
            break
    if carry:
        out.append(carry)
    return out


def best_places(total: list[int], k: int) -> list[int]:
    """Places of the k largest sums over zero, from the most significant slice down; of equal ones the lower places."""
    sure, maybe = 0, reduce(int.__or__, total, 0)
    if maybe.bit_count() <= k:
        sure, maybe = maybe, 0
    else:
        for s in reversed(total):
            x = sure | maybe & s
            n = x.bit_count()
            if n > k:
                maybe &= s
            else:
                sure, maybe = x, maybe & ~s
                if n == k:
                    maybe = 0
                    break
    out = []
    for rest in (sure, maybe):
        while rest and len(out) < k:
            out.append((rest & -rest).bit_length() - 1)
            rest &= rest - 1
    return out


def value_at(total: list[int], place: int) -> int:
    return sum((s >> place & 1) << b for b, s in enumerate(total))


# The search


def _passes(items: DataFrame) -> Iterator[list[tuple[str | int | None, list[tuple[str, int]]]]]:
    """(item_id, terms with their occurrences) of the items, in portions of bounded size."""
    portion, size = [], 0
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        _, counts = counted(row["text"])
        if counts:
            portion.append((row["item_id"], sorted(counts.items())))
            size += len(counts)
        if size >= PASS_TERMS:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def _searcher(asked, stats, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over the blocks of a task; each item's best so far are kept, so a task yields k rows an item at most."""

    def rank(x: tuple[int, int | None]) -> tuple:
        return -x[0], x[1] is None, x[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (weights, n_docs, n_terms) = asked.value, stats.value
        best: dict[int, list[tuple[int, int | None]]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0], weights, n_docs, n_terms)
                for i, (_, terms) in enumerate(items):
                    total, kept = block.scores(terms), best.get(i, [])
                    # Sums of fewer bits than the last of k kept ones are all lower than it.
                    if not total or len(kept) == k and len(total) < kept[-1][0].bit_length():
                        continue
                    found = [(value_at(total, p), block.ids[p]) for p in best_places(total, k)]
                    best[i] = sorted(kept + found, key=rank)[:k]
        rows = [{"item": i, "doc_id": d, "score": s} for i, kept in best.items() for s, d in kept]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents (doc_id, text) of each item (item_id, text).

    The documents are read once for each portion of items (one, up to PASS_TERMS).  Two numbers and the frequencies of
    the portion's terms go through the driver; the rest stays in tasks over blocks, and only k rows an item and task
    are shuffled.
    """
    spark, out = docs.sparkSession, None
    kind = items.schema["item_id"].dataType.simpleString()
    for portion in _passes(items):
        terms = frozenset(t for _, counts in portion for t, _ in counts)
        blocks = saved(index_blocks(docs, spark.sparkContext.broadcast(terms)), "impact-blocks")
        n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        dfs = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
        weights = {r["terms"]: weight(n_docs, r["df"]) for r in dfs.toLocalIterator()}  # of the portion's terms at most
        context = spark.sparkContext
        run = _searcher(context.broadcast(portion), context.broadcast((weights, n_docs, n_terms)), k)
        found = blocks.mapInArrow(run, "item int, doc_id long, score long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        found = found.withColumn("rank", place).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(portion)], f"item int, item_id {kind}")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (
  SELECT *, len(ts) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL) WHERE len(ts) > 0
), s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d), q AS (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT i, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))) GROUP BY ALL
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
