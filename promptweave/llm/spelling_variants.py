"""Spelling variant grouping: words whose neighbours at one edit are far more frequent are forms of them.

The vocabulary is cut, in order, into compact tries of bounded size; they are broadcast in rounds of bounded size, and
every word's distance-one automaton meets every trie depth first.  A task reduces what it finds to a count and the best
form for each word, so never a row for each pair is shuffled.

Defined results: null and empty texts have no words; rows repeated count again; a null doc_id reads as the empty string
in the rule that thins runs out; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, saved, small_batches

#: Runs of letters, once A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
THINNED = 199
LEAST_CHARS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent.
TIMES = 5
#: Most code points in one trie (a longer word is a trie of its own), and most bytes of tries broadcast in one round.
SHARD_CHARS = 1 << 18
ROUND_BYTES = 32 << 20
#: Most words that a task counts before it passes them on.
_HELD = 1 << 18
_LONG = 1 << 20


# Words


def thinned(doc_id: int | None, run: str) -> str:
    """The run, or one in THINNED of them without one code point; which, its document and itself decide."""
    h = zlib.crc32(run.encode(), zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id))
    if h % THINNED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs_of(text: str) -> Counter:
    """Runs of a text with their occurrences; only A-Z is lower-cased."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # on bytes, lower() knows ASCII only
    return Counter(RUN.findall(text) if len(text) < _LONG else (m.group() for m in RUN.finditer(text)))


def _counting(least_chars: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for r, n in runs_of(text).items() if text else ():
                    if len(r) >= least_chars:  # a run thinned is shorter still
                        w = thinned(doc_id, r)
                        if len(w) >= least_chars:
                            held[w] = held.get(w, 0) + n
                if len(held) >= _HELD:
                    yield out()
                    held = {}
        if held:
            yield out()

    return run


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of all documents that are long and frequent enough."""
    small_batches(docs.sparkSession)
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counting(least_chars), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# Tries


class Trie:
    """A path-compressed trie in flat arrays.  Nodes lie level by level, so that the children of node i are the nodes
    kids[i] .. kids[i + 1] - 1, by their labels' first code points; counts holds n where a word ends, else 0."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        """Of distinct words in code-point order."""
        # Nodes of the path to the last word: [depth, n, children, a word below, depth of the parent].
        root = [0, 0, [], "", 0]
        path = [root]
        before = ""
        for word, n in zip(words, counts, strict=True):
            common, last = _common(before, 0, word, 0), None
            while path[-1][0] > common:
                last = path.pop()
            if path[-1][0] < common:  # the edge to the last node is cut in two
                middle = [common, 0, [last], last[3], last[4]]
                last[4] = common
                path[-1][2][-1] = middle
                path.append(middle)
            if len(word) == common:
                path[-1][1] = n
            else:
                leaf = [len(word), n, [], word, common]
                path[-1][2].append(leaf)
                path.append(leaf)
            before = word
        pool, firsts, size = [], [], 0
        self.ends, self.kids, self.counts = array("Q"), array("Q", [1]), array("Q")
        level = [root]
        while level:
            below = []
            for depth, n, children, word, above in level:
                label = word[above:depth]
                pool.append(label)
                firsts.append(label[:1] or "\0")
                size += len(label)
                self.ends.append(size)
                self.counts.append(n)
                below += children
                self.kids.append(self.kids[-1] + len(children))
            level = below
        self.pool, self.firsts = "".join(pool), "".join(firsts)

    def label(self, node: int) -> str:
        return self.pool[self.ends[node - 1] if node else 0 : self.ends[node]]

    def _rest(self, node: int, skip: int, word: str, i: int) -> int:
        """n of the word whose last part, from `skip` code points into the node's label, is word[i:]; 0 if there is none."""
        while True:
            label = self.label(node)[skip:]
            if not word.startswith(label, i):
                return 0
            i += len(label)
            if i == len(word):
                return self.counts[node]
            node = self.firsts.find(word[i], self.kids[node], self.kids[node + 1])
            if node < 0:
                return 0
            skip = 0

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words of the trie at exactly one inserted, deleted or replaced code point, with their n, each once.

        Depth first along the automaton: while nothing is edited only the word's own path is open; where a label leaves
        it after i code points, the edit can only be there, and what follows has to match to the end.
        """
        size, node, i = len(word), 0, 0

        def leaving(child: int, skip: int, i: int) -> Iterator[tuple[str, int]]:
            other = self.pool[self.ends[child - 1] + skip]
            if i < size and (n := self._rest(child, skip + 1, word, i + 1)):
                yield word[:i] + other + word[i + 1 :], n
            if n := self._rest(child, skip + 1, word, i):
                yield word[:i] + other + word[i:], n
            if i + 1 < size and word[i + 1] == other and (n := self._rest(child, skip, word, i + 1)):
                yield word[:i] + word[i + 1 :], n

        while True:
            if i == size - 1 and self.counts[node]:
                yield word[:i], self.counts[node]
            first, end = self.kids[node], self.kids[node + 1]
            own = self.firsts.find(word[i], first, end) if i < size else -1
            for child in range(first, end):
                if child != own:
                    yield from leaving(child, 0, i)
            if own < 0:
                return
            label = self.label(own)
            if not word.startswith(label, i):
                same = _common(label, 0, word, i)
                yield from leaving(own, same, i + same)
                return
            node, i = own, i + len(label)


def _common(a: str, at: int, b: str, bt: int) -> int:
    """Length of the longest common prefix of a[at:] and b[bt:]."""
    n, most = 0, min(len(a) - at, len(b) - bt)
    while n < most:  # in doubling steps while they agree, so that long words cost little
        step = 1
        while step <= most - n and a[at + n : at + n + step] == b[bt + n : bt + n + step]:
            n += step
            step *= 2
        if n < most and a[at + n] != b[bt + n]:
            return n
    return n


def _shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts, size = [], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Trie(words, counts))], pa.binary())], ["trie"])

    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if words and size + len(word) > SHARD_CHARS:
                yield out()
                words, counts, size = [], [], 0
            words.append(word)
            counts.append(n)
            size += len(word)
    if words:
        yield out()


def tries(words: DataFrame) -> DataFrame:
    """trie: compact tries over neighbouring words, in pickled form, each of SHARD_CHARS code points at most."""
    size = words.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = max(1, math.ceil(size / SHARD_CHARS))
    return words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(_shard_batches, "trie binary")


def _rounds(shards: DataFrame) -> Iterator[list[bytes]]:
    held, size = [], 0
    for row in shards.toLocalIterator():
        if held and size + len(row["trie"]) > ROUND_BYTES:
            yield held
            held, size = [], 0
        held.append(bytes(row["trie"]))
        size += len(row["trie"])
    if held:
        yield held


def _searching(shared):
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [pickle.loads(x) for x in shared.value]
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                n_near, best = 0, None
                for shard in shards:
                    for other, n in shard.near(word):
                        n_near += 1
                        if best is None or (-n, other) < best:
                            best = (-n, other)
                if best is not None:
                    rows.append((word, n_near, best[1], -best[0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def nearest(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: the number of words (word, n) at distance one and the most frequent of them, of equal
    ones the smallest; words without any have no row.  words is read once for each round of tries."""
    spark, out = words.sparkSession, None
    small_batches(spark)
    dealt = words.select("word").repartition(spark.sparkContext.defaultParallelism * 4)
    for held in _rounds(saved(tries(words), "tries")):
        run = _searching(spark.sparkContext.broadcast(held))
        found = saved(dealt.mapInArrow(run, "word string, n_near long, form string, form_n long"), "near-words")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("w"))).alias("b")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.w").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root of (word, form): the last of the forms that follow each other, by doubling steps.

    Each form is TIMES as frequent as the one before, so a chain is no longer than the logarithm of the largest n.
    """
    steps = max(1, math.floor(math.log(max(most, 1)) / math.log(TIMES)) + 1)
    at = saved(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        at = saved(at.join(ahead, "root").select("word", F.col("ahead").alias("root")), "roots")
    return at


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of documents (doc_id, text)."""
    words = saved(vocabulary(docs, least_chars, least_count), "vocabulary")
    most = words.agg(F.max("n")).first()[0] or 0
    rows = words.join(nearest(words), "word", "left")
    taken = F.col("form_n") >= F.col("n") * times
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"))
    rows = saved(rows, "variants")
    return rows.join(roots(rows, most), "word")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab
), runs AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL
), hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(concat(doc_id, ':', w))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda a, b: xor(a // 256, tab[1 + xor(a % 256, b)]))) AS h FROM runs, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, CAST(h % length(w) AS BIGINT)) || substring(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
  SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.n = best_n) END AS form,
    CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s USING (word) JOIN formed l ON l.word = s.at WHERE l.form IS NULL
"""
