"""Toxicity: a factorization machine over hashed words and beginnings of words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, free_name, in_fold, read_table, small_batches
from .sampling import bounded_per_label

#: The fit's sample: labelled rows of each class, and characters of their texts, in expectation.  Rows are taken whole.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 3000, 8_000_000
HASH_BITS = 20
#: Evidence in nats, beyond the logarithm of how many terms or pairs are tested for each one let in, that lets one in:
#: about one in twenty of those let in may be noise, and many rare terms together ask for less than one alone.
EVIDENCE = 3.0
LEAST_ROWS = 3
#: Terms among which every pair is tested: those in the most sampled rows.
PAIR_TERMS = 2000
FACTORS = 4
ROUNDS, STEPS = 3, 300
#: Share of the terms that tell alone hidden from each step, so that one telling term is enough and none leans on its
#: companions.  Terms let in by pairs are always seen.
DROPOUT = 0.5
#: Spread of the factors at the start: of terms that tell alone and of terms of telling pairs.
ALONE, PAIRED = 0.01, 0.2
L2_WEIGHTS, L2_FACTORS = 1e-5, 1e-3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 500_000


def _hash(kind: bytes, word: str) -> int:
    return zlib.crc32(kind + word.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)


def terms(word: str) -> tuple[int, list[int], list[int]]:
    """Hashes of a word, of its beginnings of three to seven letters, and of each beginning as one that several
    distinct words of a text share."""
    starts = [word[:n] for n in range(3, min(7, len(word)) + 1)]
    return _hash(b"w ", word), [_hash(b"p ", x) for x in starts], [_hash(b"q ", x) for x in starts]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def terms_of(text: str | None) -> set[int]:
    """All terms of a text: its words, their beginnings, and the beginnings of two distinct words or more."""
    wholes, once, shared = set(), set(), set()
    for word in words_of(text):
        whole, starts, again = terms(word)
        wholes.add(whole)
        shared.update(two for one, two in zip(starts, again) if one in once)
        once.update(starts)
    return wholes | once | shared


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>), over the distinct selected terms of a text."""

    slots: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, present: list[int]) -> float:
        if not present:
            z = self.bias
        else:
            v = self.factors[present]
            s = v.sum(axis=0)
            z = self.bias + self.weights[present].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _evidence(n: np.ndarray, hits: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Chernoff bound, in nats, on seeing `hits` toxic rows of n where the machine expects `expected`."""
    rows = np.maximum(n, 1)
    k, p = hits / rows, np.clip(expected / rows, 1e-6, 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        both = np.where(k > 0, k * np.log(k / p), 0) + np.where(k < 1, (1 - k) * np.log((1 - k) / (1 - p)), 0)
    return np.where(n >= LEAST_ROWS, n * both, 0)


def _bar(found: np.ndarray, tested: int) -> float:
    """Least evidence let in: the k strongest of `tested` are, for the largest k whose weakest has ln(tested / k) +
    EVIDENCE nats (the false discovery rate of Benjamini and Hochberg); infinite if none has."""
    ranked = np.sort(found[found >= EVIDENCE])[::-1]
    enough = np.flatnonzero(ranked >= np.log(max(2, tested) / np.arange(1, len(ranked) + 1)) + EVIDENCE)
    return float(ranked[enough[-1]]) if len(enough) else np.inf


def _telling_terms(row: np.ndarray, col: np.ndarray, size: int, labels: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Terms whose rows are toxic more or less often than the machine expects of them."""
    n = np.bincount(col, minlength=size)
    found = _evidence(n, np.bincount(col, labels[row], size), np.bincount(col, p[row], size))
    return np.flatnonzero(found >= _bar(found, int((n >= LEAST_ROWS).sum())))


def _telling_pairs(row: np.ndarray, col: np.ndarray, size: int, labels: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Terms of the pairs whose common rows are toxic more or less often than the machine expects of them; neither
    term needs to tell anything alone."""
    n = np.bincount(col, minlength=size)
    often = np.argsort(-n, kind="stable")[:PAIR_TERMS]
    often = often[n[often] >= LEAST_ROWS]
    if len(often) < 2:
        return np.empty(0, np.int64)
    place = np.full(size, -1)
    place[often] = np.arange(len(often))
    x = np.zeros((len(labels), len(often)), np.float32)
    on = place[col] >= 0
    x[row[on], place[col[on]]] = 1
    m = len(often)
    both = x.T @ x
    hits = x[labels > 0].T @ x[labels > 0]
    expected = (x * p[:, None].astype(np.float32)).T @ x
    found = []
    for i in range(m - 1):  # a row of the matrix at a time keeps the tables of logarithms small
        # Terms that always stand together, such as a word and its beginning, are one term.
        apart = both[i, i + 1 :] < np.minimum(both[i, i], np.diagonal(both)[i + 1 :])
        found.append(np.where(apart, _evidence(both[i, i + 1 :], hits[i, i + 1 :], expected[i, i + 1 :]), 0).astype(np.float32))
    least = _bar(np.concatenate(found), m * (m - 1) // 2)
    told = np.zeros(m, bool)
    for i, x in enumerate(found):
        told[i] |= (x >= least).any()
        told[i + 1 :] |= x >= least
    return often[told]


def _fit_chosen(row: np.ndarray, col: np.ndarray, paired: np.ndarray, labels: np.ndarray, dropout: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the log-loss of the whole sample; paired: whether a pair let the term in."""
    n, m = len(labels), len(paired)
    rng = np.random.default_rng(7)
    spread = np.where(paired, PAIRED, ALONE)
    theta = [np.array([np.log(labels.mean() / (1 - labels.mean()))]), np.zeros(m), rng.normal(0, 1, (m, FACTORS)) * spread[:, None]]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]

    def by(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(index, values, minlength=size)

    all_row, all_col, seen = row, col, paired[col]
    for step in range(1, STEPS + 1):
        bias, w, v = theta
        keep = seen | (rng.random(len(all_col)) >= dropout)
        row, col = all_row[keep], all_col[keep]
        sums = np.stack([by(row, v[col, f], n) for f in range(FACTORS)], axis=1)
        squares = by(row, (v[col] ** 2).sum(axis=1), n)
        z = bias[0] + by(row, w[col], n) + 0.5 * ((sums**2).sum(axis=1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
        grad_v = np.stack([by(col, g[row] * (sums[row, f] - v[col, f]), m) for f in range(FACTORS)], axis=1)
        grads = [np.array([g.sum()]), by(col, g[row], m) + L2_WEIGHTS * w, grad_v + L2_FACTORS * v]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.99 * second[i] + 0.01 * d * d
            theta[i] = theta[i] - 0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return float(theta[0][0]), theta[1], theta[2]


def fit_machine(sample: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Terms are let in by score tests and the machine is fitted again, ROUNDS times at most.

    A test compares how many of a term's (or pair's) rows are toxic with how many the machine so far expects, and asks
    for more evidence the more terms are tested.  So a rare term that alone explains its rows comes in, a pair whose
    parts tell nothing alone comes in, and a companion of known terms, already explained, does not.  With no rows the
    score is 0; with one class it is that class.
    """
    if not len(labels) or labels.min() == labels.max():
        sure = 40.0 if len(labels) and labels[0] else -40.0
        return Machine({}, sure, np.zeros(0), np.zeros((0, FACTORS)))
    known, col = np.unique(np.concatenate(sample).astype(np.int64), return_inverse=True)
    row = np.repeat(np.arange(len(sample)), [len(t) for t in sample])
    chosen, paired = np.empty(0, np.int64), np.zeros(len(known), bool)
    p = np.full(len(labels), labels.mean())

    def fitted(dropout: float) -> Machine:
        slot = np.full(len(known), -1)
        slot[chosen] = np.arange(len(chosen))
        on = slot[col] >= 0
        machine = Machine({int(h): i for i, h in enumerate(known[chosen])}, *_fit_chosen(row[on], slot[col[on]], paired[chosen], labels, dropout))
        ends, inside = np.searchsorted(row[on], np.arange(len(labels) + 1)), slot[col[on]]
        p[:] = [machine.score(inside[i:j].tolist()) for i, j in zip(ends, ends[1:])]
        return machine

    for _ in range(ROUNDS):
        fresh = np.setdiff1d(_telling_terms(row, col, len(known), labels, p), chosen)
        if not len(fresh):
            pairs = _telling_pairs(row, col, len(known), labels, p)
            fresh = pairs[~paired[pairs]]
            paired[pairs] = True
        if not len(fresh):
            break
        chosen = np.union1d(chosen, fresh)
        fitted(0)  # the next test asks what is left unexplained, so nothing is hidden here
    if not len(chosen):
        return Machine({}, float(np.log(labels.mean() / (1 - labels.mean()))), np.zeros(0), np.zeros((0, FACTORS)))
    return fitted(DROPOUT)


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for text in batch.column("text").to_pylist():
            packed.append(np.array(sorted(terms_of(text)), np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(packed, pa.binary())], ["y", "terms"])


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on labelled rows outside the held-out fold.  Null labels and ids are left out; of several labels of one
    document the largest holds.  The sample is bounded by SAMPLE_PER_CLASS rows and SAMPLE_CHARS characters a class,
    in expectation, and so is what reaches the driver: four bytes for each distinct term of a sampled row."""
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT))
    ids = ids.groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    sizes = docs.agg(F.coalesce(F.avg(F.length("text")), F.lit(0.0))).first()[0]
    rows = max(1, min(SAMPLE_PER_CLASS, int(SAMPLE_CHARS / max(1.0, sizes))))
    # At most that many ids of each class in expectation: bounded, so fit to broadcast.
    chosen = F.broadcast(bounded_per_label(ids, "y", F.col("id"), rows))
    found = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("y", "text")
    got = found.mapInArrow(_term_batches, "y int, terms binary").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["terms"])))
    return fit_machine([np.frombuffer(bytes(r["terms"]), np.int32) for r in got], np.array([r["y"] for r in got], float))


class Scorer:
    """Scores texts; what a word adds is looked up once."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.known = machine, {}

    def _slots(self, word: str) -> tuple:
        """Slots of the word and its beginnings, and (beginning's hash, slot) of those that count where they are shared."""
        slots = self.machine.slots
        whole, starts, again = terms(word)
        return tuple(slots[h] for h in (whole, *starts) if h in slots), tuple((one, slots[two]) for one, two in zip(starts, again) if two in slots)

    def score(self, text: str | None) -> float:
        known, present, once = self.known, set(), set()
        if len(known) > _CACHE:
            known.clear()
        for word in words_of(text):
            at = known.get(word)
            if at is None:
                at = known[word] = self._slots(word)
            if at[0]:
                present.update(at[0])
            for start, slot in at[1]:
                if start in once:
                    present.add(slot)
                once.add(start)
        return self.machine.score(sorted(present))


def _score_batches(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return run


def scored(docs: DataFrame, labels: DataFrame, name: str = "toxicity") -> DataFrame:
    """docs with the column `name`, 0 to 1; higher: label 1 likelier.

    Only the text is an input of a score.  Null, empty and wordless texts get the score of a text without known terms.
    Columns, order of columns and repeated rows stay; an empty table gives none.  docs has no column `name`; to be safe
    from clashes ask `free_name`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))  # bounded by the sample's terms
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_score_batches(model, name), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more; columns as they were, whatever their names."""
    name = free_name(docs, "toxicity")
    return scored(docs, labels, name).filter(F.col(name) < threshold).drop(name)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"), "score")
    held_out = in_fold(F.col("doc_id"), FOLDS, HELD_OUT)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
