"""Benchmark decontamination: pigeonhole edit matching over words, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches

#: Word edits allowed per word of a test item: a similarity of 0.8 or more counts.
ERROR_RATE = 0.2
#: Characters of test items in one broadcast; a larger benchmark is matched in as many blocks as it takes.
BLOCK_CHARS = 8_000_000
# Scripts written without blanks, of which every character is a word: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(r"\w+")
_WORD_OR_SIGN = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")
_SCHEMA = "doc_id long, item_id long, distance int, n_item_words int, start_word int, end_word int"


def words_of(text: str | None) -> list[str]:
    """Runs of word characters, lower-cased; in scripts without blanks each character."""
    text = (text or "").lower()
    return (_WORD if text.isascii() else _WORD_OR_SIGN).findall(text)


@dataclass
class Item:
    item_id: int
    size: int
    budget: int
    masks: dict[str, int]
    pieces: list[tuple[int, str]]


def prepare(item_id: int, text: str | None, rate: float = ERROR_RATE) -> Item | None:
    """An item cut into budget + 1 runs of words, (first word, words joined by blanks).

    `budget` edits touch at most `budget` of the pieces, so a match leaves one piece unchanged.  The budget of a short
    item is none: it is found as it stands.
    """
    words = words_of(text)
    if not words:
        return None
    budget = int(len(words) * rate)
    cuts = [len(words) * i // (budget + 1) for i in range(budget + 2)]
    masks: dict[str, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return Item(item_id, len(words), budget, masks, [(i, " ".join(words[i:j])) for i, j in zip(cuts, cuts[1:])])


def myers_best(masks: dict[str, int], size: int, text: list[str]) -> tuple[int, int]:
    """Least edit distance of the pattern to any run of text, and the end (exclusive) of the first such run."""
    full, last = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best, end = full, 0, size, size, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        rise = down | (full & ~(horizontal | up))
        fall = up & horizontal
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise = (rise << 1) & full
        fall = (fall << 1) & full
        up = fall | (full & ~(vertical | rise))
        down = rise & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds items of one block in texts."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float = ERROR_RATE) -> None:
        self.items = [x for x in (prepare(i, t, rate) for i, t in items) if x]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for first, piece in item.pieces:
                where.setdefault(piece, []).append((n, first))
        self.automaton = ahocorasick.Automaton() if where else None
        for piece, at in where.items():
            self.automaton.add_word(f" {piece} ", (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, item's words, first word, end) of each item within its budget; the least distance."""
        words = words_of(text)
        if self.automaton is None or not words:
            return []
        line = f" {' '.join(words)} "
        starts, near, found = None, {}, {}
        for end, (length, at) in self.automaton.iter(line):
            if starts is None:
                starts = np.cumsum([1, *(len(w) + 1 for w in words[:-1])])
            word = int(np.searchsorted(starts, end - length))
            for n, first in at:
                near.setdefault(n, set()).add(max(0, word - first - self.items[n].budget))
        for n, lows in near.items():
            item = self.items[n]
            for low, high in _merged(sorted(lows), item.size + 2 * item.budget):
                distance, stop = myers_best(item.masks, item.size, words[low:high])
                if distance <= item.budget and (distance, low + stop) < found.get(n, (item.budget + 1, 0))[:2]:
                    found[n] = (distance, low + stop)
        return [(self.items[n].item_id, d, self.items[n].size, max(0, stop - self.items[n].size), stop) for n, (d, stop) in sorted(found.items())]


def _merged(lows: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Windows of `size` words from each place on, those that touch as one: a text is read once for an item, however
    often its pieces stand there."""
    start, end = lows[0], lows[0] + size
    for low in lows[1:]:
        if low > end:
            yield start, end
            start = low
        end = low + size
    yield start, end


def _match_batches(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value)
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in matcher.find(t)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "distance", "n_item_words", "start_word", "end_word"])

    return run


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_chars characters: what is broadcast has a size bound."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_chars))
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in block.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and test item found in it, with the least word distance and where it stands.

    Words are runs of word characters, lower-cased, and in scripts without blanks each character.  An item of n words
    is found where some run of the document's words is within floor(n / 5) edits, so one of fewer than five words where
    it stands unchanged, and one of fewer than LEAST_CHARS characters where it is all that the document says.  Only
    clean documents have no row.  Null texts and texts without words match nothing; items of equal text are found
    each; rows repeated under one doc_id are matched each; empty tables give no rows.  The pass over the documents is
    map-only: no shuffle, whatever their skew.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = None
    for items in blocks_of(benchmark, block_chars):
        part = docs.select("doc_id", "text").mapInArrow(_match_batches(spark.sparkContext.broadcast(items)), _SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a test item; columns as they were.  Map-only: rows are filtered where they stand."""
    spark = docs.sparkSession
    small_batches(spark)
    for items in blocks_of(benchmark):
        docs = docs.mapInArrow(_clean_batches(spark.sparkContext.broadcast(items)), docs.schema)
    return docs


def _clean_batches(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
