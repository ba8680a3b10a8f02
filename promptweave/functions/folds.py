"""Folds over long arrays of one row.

Adding to an array copies it, so a fold that adds an element at each step is quadratic.  Here arrays are cut into blocks:
a fold adds to a short array inside a block, and one array for each block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(items: Column) -> Column:
    last = F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def by_blocks(items: Column, f: Callable[[Column], Column]) -> Column:
    """The arrays that f gives for short runs of items, one after another."""
    return let(items, lambda x: F.flatten(F.transform(_blocks(x), f)))


def fold(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """struct<state, out>: the state after all items and what the steps added, an array<kind>.

    step(state, item) gives the next state and an array<kind> of what to add.
    """

    def inside(acc: Column, item: Column) -> Column:
        after, added = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], added).alias("out"))

    def over(acc: Column, block: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return let(F.aggregate(block, start, inside), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["parts"], F.array(r["out"])).alias("parts")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("parts"))
    done = let(items, lambda x: F.aggregate(_blocks(x), start, over))
    return let(done, lambda d: F.struct(d["state"].alias("state"), F.flatten(d["parts"]).alias("out")))


def running_sum(numbers: Column) -> Column:
    """array<int> of the sums up to each place."""

    def step(total: Column, x: Column) -> tuple[Column, Column]:
        return total + x, F.array(total + x)

    return fold(numbers, F.lit(0), step, "int")["out"]


def places(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the matches of pattern in code points, leftmost and non-overlapping.

    One pass splits the text at the matches, one takes them; lengths give the places.
    """
    both = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, m: g + F.length(m))
        return F.zip_with(x["found"], running_sum(sizes), lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))

    return let(both, placed)
