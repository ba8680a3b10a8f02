"""Language ID: a linear-chain conditional random field labels the words of code-switched text by forward-backward."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, in_fold, read_table, small_batches
from .sampling import bounded_per_label

FOLDS, HELD_OUT = 4, 2
#: The fit sees about so many labelled rows of each language, and of each row so many runs of RUN words, spread evenly
#: over the whole text.
SAMPLE_PER_LANG, RUNS, RUN = 300, 4, 32
HASH_BITS = 16
LEXICON_WORDS = 300
EPOCHS, BATCH, RATE, L2 = 8, 64, 0.2, 1e-6
UNKNOWN = "und"
#: Words of a chunk in the parallel forward-backward.
CHUNK = 32
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000
#: Words that are labelled at a time; a longer document takes several blocks.
_BLOCK_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _WORD.findall((text or "").lower())
    return found if (text or "").isascii() else [w for w in found if w.isascii() or any(map(str.isalpha, w))]


def _gram(points: np.ndarray, at: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Hash of the n characters from each place on; kinds do not mix."""
    h = np.full(len(at), 0x9E3779B97F4A7C15 + 2 * kind, np.uint64)
    for k in range(n):
        h = (h ^ points[at + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return (h & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, feature) of the words' affixes of one to four letters and of their letter n-grams of two and
    three, edges marked; sorted by word."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(words)), size)
    room = np.repeat(end, size) - np.arange(len(points))
    owners, found = [], []
    for n in (2, 3):
        at = np.flatnonzero(room >= n)
        owners.append(owner[at])
        found.append(_gram(points, at, n, n))
    for n in range(1, 5):
        on = np.flatnonzero(size >= n + 2)
        owners += [on, on]
        found += [_gram(points, start[on] + 1, n, 10 + n), _gram(points, end[on] - 1 - n, n, 20 + n)]
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return owners[order], found[order]


@dataclass
class Field:
    """Potentials: exp(sum of a word's feature weights) per label, times exp(transition) from the label before it.
    Before the first word stands an even mix of labels."""

    labels: list[str]
    lexicons: list[frozenset]
    weights: np.ndarray  # hashed features, then one row per lexicon
    transitions: np.ndarray  # [from, to]

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features, and for each lexicon that holds a word its own."""
        owners, found = features(words)
        listed = [(i, (1 << HASH_BITS) + k) for k, lexicon in enumerate(self.lexicons) for i, w in enumerate(words) if w in lexicon]
        more = np.array(listed, np.int64).reshape(-1, 2)
        owners, found = np.concatenate((owners, more[:, 0])), np.concatenate((found, more[:, 1]))
        order = np.argsort(owners, kind="stable")
        return owners[order], found[order]

    def emissions(self, words: list[str]) -> np.ndarray:
        owners, found = self.features(words)
        z = np.stack([np.bincount(owners, self.weights[found, k], minlength=len(words)) for k in range(len(self.labels))], axis=1)
        return np.exp(z - z.max(axis=1, keepdims=True))


class Chain:
    """Sequences in chunks of CHUNK words, so that all chunks step side by side; e [words, labels] of all sequences one
    after the other, a [from, to]."""

    def __init__(self, e: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> None:
        n_labels = e.shape[1]
        self.a, self.lengths = a, lengths
        self.per = -(-lengths // CHUNK)
        self.first = np.concatenate(([0], np.cumsum(self.per)[:-1]))
        total = int(self.per.sum())
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        inside = np.arange(len(e)) - np.repeat(begin, lengths)
        self.slot = (np.repeat(self.first, lengths) + inside // CHUNK) * CHUNK + inside % CHUNK
        pad = np.ones((total * CHUNK, n_labels))
        pad[self.slot] = e
        real = np.zeros(total * CHUNK, bool)
        real[self.slot] = True
        self.pad, self.real = pad.reshape(total, CHUNK, n_labels), real.reshape(total, CHUNK)
        m = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
        for t in range(CHUNK):
            step = (m @ a) * self.pad[:, t, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            m = np.where(self.real[:, t, None, None], step, m)
        #: Path sums of each chunk, from the label before it to its last one.
        self.matrices = m

    def whole(self) -> np.ndarray:
        """Path sums of the first sequence."""
        found = np.eye(self.matrices.shape[1])
        for m in self.matrices[: self.per[0]]:
            found = found @ m
            found /= found.max()
        return found

    def run(self, left: np.ndarray | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward weights of every word, each up to a factor; left and right [sequences, labels] are what
        stands before and after the sequences."""
        total, _, k = self.pad.shape
        left = np.full((len(self.per), k), 1 / k) if left is None else left.copy()
        right = np.ones((len(self.per), k)) if right is None else right.copy()
        enter, leave = np.empty((total, k)), np.empty((total, k))
        for c in range(int(self.per.max())):
            on = np.flatnonzero(self.per > c)
            at = self.first[on] + c
            enter[at] = left[on]
            v = np.einsum("ni,nij->nj", left[on], self.matrices[at])
            left[on] = v / v.sum(axis=1, keepdims=True)
            back = self.first[on] + self.per[on] - 1 - c
            leave[back] = right[on]
            v = np.einsum("nij,nj->ni", self.matrices[back], right[on])
            right[on] = v / v.sum(axis=1, keepdims=True)
        alpha, beta = np.empty_like(self.pad), np.empty_like(self.pad)
        v = enter
        for t in range(CHUNK):
            step = (v @ self.a) * self.pad[:, t]
            v = np.where(self.real[:, t, None], step / step.sum(axis=1, keepdims=True), v)
            alpha[:, t] = v
        v = leave
        for t in range(CHUNK - 1, -1, -1):
            beta[:, t] = v
            step = (v * self.pad[:, t]) @ self.a.T
            v = np.where(self.real[:, t, None], step / step.sum(axis=1, keepdims=True), v)
        return alpha.reshape(-1, k)[self.slot], beta.reshape(-1, k)[self.slot]


def posteriors(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


def forward_backward(e: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Posterior label distribution of every word."""
    return posteriors(*Chain(e, lengths, a).run())


def pair_posteriors(alpha: np.ndarray, beta: np.ndarray, e: np.ndarray, a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[pairs, from, to]: posterior of the labels of words `at` and the next ones."""
    joint = alpha[at][:, :, None] * a[None] * (e[at + 1] * beta[at + 1])[:, None, :]
    return joint / joint.sum(axis=(1, 2), keepdims=True)


def spliced(sample: list[tuple[str, list[str]]], rng: np.random.Generator) -> list[tuple[list[str], list[str]]]:
    """(words, labels): every run as it is, and as many again that switch, of the first part of a run and the last part
    of another."""
    out = [(run, [lang] * len(run)) for lang, run in sample]
    for i, j in enumerate(rng.permutation(len(sample))):
        (one, a), (two, b) = sample[i], sample[j]
        m, n = rng.integers(0, len(a) + 1), rng.integers(0, len(b) + 1)
        if m + len(b) - n:
            out.append((a[:m] + b[n:], [one] * m + [two] * (len(b) - n)))
    return out


def fit_field(sample: list[tuple[str, list[str]]]) -> Field:
    """Runs of words, each labelled with its document's language -> weights that raise the likelihood of the labels of
    the runs and of their splices, by AdaGrad on its exact gradient."""
    labels = sorted({lang for lang, _ in sample})
    counts = {lang: Counter() for lang in labels}
    for lang, run in sample:
        counts[lang].update(run)
    lexicons = [frozenset(w for w, _ in sorted(counts[x].items(), key=lambda c: (-c[1], c[0]))[:LEXICON_WORDS]) for x in labels]
    k = len(labels)
    field = Field(labels, lexicons, np.zeros(((1 << HASH_BITS) + k, k)), np.zeros((k, k)))
    if k < 2:
        return field
    words = sorted({w for _, run in sample for w in run})
    owners, found = field.features(words)
    rows = dict(zip(words, np.split(found, np.searchsorted(owners, np.arange(1, len(words))))))
    rng = np.random.default_rng(11)
    place = {lang: i for i, lang in enumerate(labels)}
    chains = spliced(sample, rng)
    sums_w, sums_t = np.full_like(field.weights, 1e-6), np.full_like(field.transitions, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for i in range(0, len(order), BATCH):
            part = [chains[j] for j in order[i : i + BATCH]]
            at = [rows[w] for run, _ in part for w in run]
            flat, sizes = np.concatenate(at), np.array([len(x) for x in at])
            owner = np.repeat(np.arange(len(at)), sizes)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            z = np.add.reduceat(field.weights[flat], starts, axis=0)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            lengths = np.array([len(run) for run, _ in part])
            a = np.exp(field.transitions)
            alpha, beta = Chain(e, lengths, a).run()
            gold = np.array([place[lang] for _, own in part for lang in own])
            diff = posteriors(alpha, beta)
            diff[np.arange(len(gold)), gold] -= 1
            touched, inverse = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(inverse, diff[owner, c], minlength=len(touched)) for c in range(k)], axis=1)
            grad = grad / len(part) + L2 * field.weights[touched]
            sums_w[touched] += grad**2
            field.weights[touched] -= RATE * grad / np.sqrt(sums_w[touched])
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            pair = np.setdiff1d(np.arange(len(gold)), np.cumsum(lengths) - 1)
            grad_t = pair_posteriors(alpha, beta, e, a, pair).sum(axis=0)
            np.subtract.at(grad_t, (gold[pair], gold[pair + 1]), 1)
            # Before the first word stands an even mix of labels.
            into = a[None] * (e[first] * beta[first])[:, None, :]
            grad_t += (into / into.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            given = a[:, gold[first]]
            np.subtract.at(grad_t.T, gold[first], (given / given.sum(axis=0)).T)
            grad_t = grad_t / len(part) + 1e-3 * field.transitions
            sums_t += grad_t**2
            field.transitions -= RATE * grad_t / np.sqrt(sums_t)
    return field


def _runs_of(text: str | None) -> list[list[str]]:
    words = words_of(text)
    if not words:
        return []
    n = min(RUNS, -(-len(words) // RUN))
    return [words[i : i + RUN] for i in (max(0, len(words) - RUN) * k // max(1, n - 1) for k in range(n))]


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, " ".join(run)) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) for run in _runs_of(text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["lang", "run"])


def fit(docs: DataFrame) -> Field:
    """Fit on rows outside the held-out fold with a language; bounded by SAMPLE_PER_LANG, RUNS and RUN."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_bucket(F.col("doc_id"), FOLDS), F.lit(HELD_OUT)) != HELD_OUT))
    sample = bounded_per_label(rows, "lang", F.col("doc_id"), SAMPLE_PER_LANG)
    got = sample.select("lang", "text").mapInArrow(_run_batches, "lang string, run string").collect()
    return fit_field(sorted((r["lang"], r["run"].split(" ")) for r in got))


class Labeller:
    """Labels the words of texts, a bounded block of words at a time."""

    def __init__(self, field: Field, block: int = _BLOCK_WORDS) -> None:
        self.field, self.block = field, block
        self.a, self.k = np.exp(field.transitions), len(field.labels)
        self.known: dict[str, int] = {}
        self.table = np.empty((0, self.k))

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row for each word; each distinct word's is computed once."""
        known = self.known
        if len(known) > _CACHE:
            known.clear()
            self.table = np.empty((0, self.k))
        fresh, codes = [], []
        for w in words:
            c = known.get(w)
            if c is None:
                c = known[w] = len(self.table) + len(fresh)
                fresh.append(w)
            codes.append(c)
        if fresh:
            self.table = np.concatenate((self.table, self.field.emissions(fresh)))
        return self.table[codes]

    def long(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed posteriors and labels of one text of several blocks.  A first pass keeps each block's path sums, from
        which what stands before and after every block follows; a second one labels the blocks."""
        parts = [words[i : i + self.block] for i in range(0, len(words), self.block)]
        sums = [Chain(self.emissions(p), np.array([len(p)]), self.a).whole() for p in parts]
        left, right = [np.full(self.k, 1 / self.k)], [np.ones(self.k)]
        for m in sums[:-1]:
            left.append((v := left[-1] @ m) / v.sum())
        for m in sums[:0:-1]:
            right.append((v := m @ right[-1]) / v.sum())
        total, found = np.zeros(self.k), []
        for p, before, after in zip(parts, left, right[::-1]):
            post = posteriors(*Chain(self.emissions(p), np.array([len(p)]), self.a).run(before[None], after[None]))
            total += post.sum(axis=0)
            found.append(post.argmax(axis=1))
        return total, np.concatenate(found)

    def short(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for texts of a block together."""
        lengths = np.array([len(t) for t in texts])
        post = forward_backward(self.emissions([w for t in texts for w in t]), lengths, self.a)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return list(zip(np.add.reduceat(post, begin, axis=0), np.split(post.argmax(axis=1), begin[1:])))

    def labelled(self, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index, summed posteriors, labels) of each text with words."""
        at, held, size = [], [], 0
        for i, words in enumerate(texts):
            if len(words) > self.block:
                yield i, *self.long(words)
                continue
            if not words:
                continue
            if size + len(words) > self.block:
                yield from ((j, *x) for j, x in zip(at, self.short(held)))
                at, held, size = [], [], 0
            at.append(i)
            held.append(words)
            size += len(words)
        if held:
            yield from ((j, *x) for j, x in zip(at, self.short(held)))


_RUN_TYPE = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))


def _label_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        labeller = Labeller(field)
        for batch in batches:
            n = batch.num_rows
            preds, scores, runs = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
            texts = [words_of(t) if field.labels else [] for t in batch.column("text").to_pylist()]
            for i, total, own in labeller.labelled(texts):
                share = total / len(own)
                best = int(np.argmax(share))
                preds[i], scores[i] = field.labels[best], min(1.0, float(share[best]))
                cut = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)])).tolist()
                runs[i] = [{"lang": field.labels[own[x]], "first": x, "words": y - x} for x, y in zip(cut, cut[1:])]
            cols = [batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(runs, _RUN_TYPE)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "runs"])

    return run


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, lang_pred, score, runs.

    runs, array<struct<lang, first, words>>, are the stretches of words with the same likeliest label, in text order.
    lang_pred is the learned language with the largest sum of word posteriors over the whole text, score its share;
    of equal ones the first in the alphabet.  Null, empty and letterless texts get `und`, 0 and no runs, and so does
    all where no row is labelled.  Repeated rows are each returned; an empty table gives no rows.  Of the predicted
    row only the text is used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs))  # 2^16 features x languages
    return docs.select("doc_id", "text").mapInArrow(_label_batches(shared), "doc_id long, lang_pred string, score double, runs array<struct<lang:string,first:int,words:int>>")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages(read_table(spark, sf_dir, "documents"))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["lang"], r["first"].cast("string"), r["words"].cast("string"))), ",")
    return found.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score", said.alias("runs"))
