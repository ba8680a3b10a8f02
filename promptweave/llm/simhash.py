"""SimHash near-dedup: 64-bit fingerprints, linked within a Hamming radius by BK-trees over shards of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, read_table, saved, small_batches
from .components import component_roots

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Bits of the blocks a fingerprint is cut into.  At most RADIUS differing bits leave two of the six blocks alike.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Most fingerprints in one shard tree.  A larger shard is cut into pieces; every pair of pieces is compared.
PIECE = 4096
_UNPACK = 1 << 17


def shingle_hashes(data: bytes, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of every shingle of a UTF-8 text, A-Z lower-cased."""
    tokens = data.lower().split()  # on bytes, both know ASCII only
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)] if tokens else []
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], SEED) for i, j in zip(starts, (ends[words - 1 :] - 1).tolist())]


def majority(hashes: list[int]) -> int:
    """The number whose bits are those set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _UNPACK):
        part = np.array(hashes[i : i + _UNPACK], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [majority(h) if (h := shingle_hashes((t or "").encode("utf-8", "surrogatepass"))) else 0 for t in batch.column("text").to_pylist()]
        signed = pa.array(np.array(marks, np.uint64).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; zero for null, empty and blank texts."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance; a child hangs under its parent by its distance to it."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """All members within the radius: only edges d - radius .. d + radius can lead to one."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if children:
                low, high = d - radius, d + radius
                todo.extend(c for e, c in children.items() if low <= e <= high)
        return found


def spanning_links(tree_side: list[int], query_side: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within the radius connect: members of tree_side with each other where query_side
    is None, else with those of query_side.  A spanning forest, so never more links than members."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    tree, links = BKTree(), []

    def link(x: int) -> None:
        for y in tree.within(x, radius):
            a, b = top(x), top(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((x, y))

    if query_side is None:
        for x in tree_side:
            link(x)
            tree.add(x)
    else:
        for x in tree_side:
            tree.add(x)
        for x in query_side:
            link(x)
    return links


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (shard, first, second): each run is one shard, or one pair of pieces of a large shard."""
        out: list[tuple[int, int]] = []
        key, sides = None, ([], [])

        def flush() -> None:
            if key is not None:
                same = key[1] == key[2]
                if len(sides[0]) + len(sides[1]) > 1:
                    out.extend(spanning_links(sides[0], None if same else sides[1], radius))

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "first", "second", "piece", "fp")]
            if not len(cols[0]):
                continue
            cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            bounds = [0, *cut.tolist(), len(cols[0])]
            for i, j in zip(bounds, bounds[1:]):
                k = (int(cols[0][i]), int(cols[1][i]), int(cols[2][i]))
                if k != key:
                    flush()
                    key, sides = k, ([], [])
                for piece, fp in zip(cols[3][i:j].tolist(), cols[4][i:j].view(np.uint64).tolist()):
                    sides[piece != key[1]].append(fp)
            if len(out) >= 10_000:
                yield _pairs(out)
                out.clear()
        flush()
        if out:
            yield _pairs(out)

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def shard_rows(marks: DataFrame) -> DataFrame:
    """marks (fp) -> (shard, fp): a row for each pair of blocks; the shard is the pair and the two blocks' bits."""
    low = np.concatenate(([0], np.cumsum(BLOCKS)[:-1])).tolist()
    shards = []
    for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        one, two = (f"(shiftrightunsigned(fp, {low[k]}) & {(1 << BLOCKS[k]) - 1})" for k in (i, j))
        shards.append(f"({n}L << 40) | ({one} << 20) | {two}")
    return marks.select(F.explode(F.array(*[F.expr(s) for s in shards])).alias("shard"), "fp")


def near_links(marks: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """marks (fp, distinct) -> (a, b): links that join exactly what pairs within the radius (at most 4) join.

    Fingerprints that close agree on two of six blocks, so all of them meet in a shard of that pair of blocks.  A
    shard with more than `piece` members is cut into pieces by a hash; each pair of pieces has a tree on one side and
    queries on the other.  So a tree has a size bound, whatever the group of copies, and no candidate is left out.
    The trees travel as rows of a shuffle, not through the driver: a broadcast of all shard trees would grow with the
    corpus.
    """
    rows = shard_rows(marks)
    # Written before it is joined, so that both sides come straight from a shuffle and Spark splits a hot shard.
    sizes = saved(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shards")
    dealt = rows.join(sizes, "shard").withColumn("pieces", F.ceil(F.col("n") / piece).cast("int"))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    dealt = dealt.select("shard", "piece", "fp", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    dealt = dealt.select("shard", F.least("piece", "other").alias("first"), F.greatest("piece", "other").alias("second"), "piece", "fp")
    dealt = dealt.repartition("shard", "first", "second").sortWithinPartitions("shard", "first", "second", "fp")
    return dealt.mapInArrow(_link_batches(radius), "a long, b long")


def named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes (node, least_id) and (node, root) of those with links -> (node, component_id): the least id of a class.

    Each table is written before the next join, so that a class of any size is split over tasks.
    """
    placed = saved(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    names = saved(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "names")
    classes = saved(placed.join(names, "root").select("node", "component_id"), "classes")
    dropped(placed, names)
    return classes


def near_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits, itself included.
    Equal fingerprints are folded first, so a group of copies of any size is one node.  Null, empty and blank texts
    have fingerprint zero and are linked like any other.  Rows repeated under one doc_id are each returned; a null
    doc_id is returned with its component and is never the component's name unless no other is in it.  An empty
    table gives no rows.
    """
    marks = saved(fingerprints(docs), "fingerprints")
    nodes = saved(marks.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = component_roots(near_links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    classes = named(nodes.withColumnRenamed("fp", "node"), roots.withColumnRenamed("fp", "node"))
    dropped(nodes)
    return marks.join(classes.withColumnRenamed("node", "fp"), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each class, the one with the smallest doc_id; columns as they were."""
    gone = near_classes(docs.select("doc_id", "text"), radius).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("_pw_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_pw_id"]), "left_anti")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
