"""SentencePiece encoding and decoding, giant documents in chunks joined by a max-plus scan.

A path through a document is a sequence of tokens.  A step from token a to token b weighs

* BPE models: 0 if the model splits the string ab into exactly a, b, else minus infinity.  A merge that would cross
  the border of a and b depends on these two alone, so a sequence all of whose neighbours pass is the model's own,
  and it is the only one: the max-plus optimum equals the merge order's result.
* unigram models: b's score, so the optimum is the Viterbi segmentation.

The state at a chunk border is the token that reaches or crosses it and where that token ends.  Each chunk yields a
matrix of the best weight from every state at its left border to every state at its right one; matrices combine
associatively; the states on the best path then let every chunk be backtraced alone.

Where no piece of a BPE model holds a blank behind another character, every path has a border at each beginning of a
word, and what stands before does not matter behind it.  There all states are one, so a chunk of spaced text is the
product of its words' matrices, each of one cell; a word's own scan is made once and kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, saved, small_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk.  Longer documents are giant.
CHUNK = 16_384
#: Longest word whose path is sought depth first.
SHORT = 200
#: Words merged side by side.
MERGED = 1024
_NEVER = np.iinfo(np.int64).max
#: Chunks whose matrices are multiplied in one task.
FAN = 256
#: Texts encoded in one call, and words whose weights and ids a worker keeps.
ENCODED_ROWS, WORDS_KEPT = 64, 1 << 16
SPACE = "▁"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Character that no text can hold: the start of a document.
_NONE = ""

State = tuple[str, int]  # token, its end relative to the border
Matrix = dict[State, dict[State, float]]


class Model:
    """A SentencePiece model from its bytes: blanks become SPACE, one SPACE stands before the text."""

    def __init__(self, proto: bytes, kind: str = "bpe") -> None:
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        lib, self.kind = self.lib, kind
        plain = [i for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.scores = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.scores.values()) - 10
        #: No piece has SPACE behind another character: then no token crosses a place where a word begins.
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.bytes = {b: lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.weight = lru_cache(WORDS_KEPT)(self._weight)
        self.word_ids = lru_cache(WORDS_KEPT)(self._word_ids)
        self.merges, self.kept = None, {}  # both filled by ids_of_words

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: the best-scored pair first, of equal ones the leftmost."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(part) and (s := self.scores.get(p := part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, p))

        for i in range(len(part)):
            offer(i)
        while queue:
            _, i, p = heapq.heappop(queue)
            j = after[i] if part[i] is not None else len(part)
            if j >= len(part) or part[i] + part[j] != p:
                continue
            part[i], part[j] = p, None
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p is not None]

    def ids_of_words(self, words: list[str]) -> list[list[int]]:
        """`word_ids` of many words of a BPE model: those not met before are merged side by side.

        The path of weight 0 is the merge order's, so no other is tried; words of more than SHORT characters
        are scanned one by one.
        """
        if len(self.kept) > 2 * WORDS_KEPT:
            self.kept.clear()
        if new := [w for w in dict.fromkeys(words) if w not in self.kept]:
            self.merges = self.merges or Merges(self)
            self.kept.update(zip(new, self.merges(new)))
        return [self.kept[w] for w in words]

    def _weight(self, a: str, b: str) -> float | None:
        """Weight of the step from a to b; None: no such step."""
        if self.kind == "unigram":
            return self.scores.get(b, self.unknown_score)
        if a == _NONE:
            return 0.0 if self.merged(b) == [b] else None
        return 0.0 if self.merged(a + b) == [a, b] else None

    def tokens_at(self, text: str, i: int) -> list[str]:
        """Tokens that can start at i; a character outside the vocabulary is a token of its own."""
        found = [t for n in range(1, min(self.longest, len(text) - i) + 1) if (t := text[i : i + n]) in self.ids]
        return found if found and len(found[0]) == 1 else [text[i], *found]

    def ids_of(self, token: str) -> list[int]:
        at = self.ids.get(token)
        return [at] if at is not None else [self.bytes[b] for b in token.encode("utf-8", "surrogatepass")]

    def state(self, token: str, end: int) -> State:
        return (token if self.kind == "bpe" else _NONE, end)

    def states_at(self, left: str, right: str) -> list[State]:
        """All states at a border between left and right, of which each may be cut to `longest` characters."""
        text, n = left + right, len(left)
        found = {self.state(t, i + len(t) - n): None for i in range(max(0, n - self.longest), n) for t in self.tokens_at(text, i) if i + len(t) >= n}
        return list(found)

    def spread(self, text: str, start: State, stop: int) -> dict[int, dict[State, tuple[float, State | None, str]]]:
        """Best weights from a state at 0 to all states in text: end -> state -> (weight, state before, token).
        Tokens start before stop."""
        reach: dict[int, dict[State, tuple[float, State | None, str]]] = {start[1]: {start: (0.0, None, _NONE)}}
        for i in range(stop):
            for s, (w, _, _) in reach.get(i, {}).items():
                for t in self.tokens_at(text, i):
                    step = self.weight(s[0], t)
                    if step is None:
                        continue
                    e = i + len(t)
                    to = self.state(t, e)
                    at = reach.setdefault(e, {})
                    if to not in at or at[to][0] < w + step:
                        at[to] = (w + step, s, t)
        return reach

    def _word_ids(self, word: str) -> list[int]:
        """Ids of a word between two places where words begin, by its own scan."""
        if len(word) <= SHORT and (path := self._weightless(word)) is not None:
            return [i for t in path for i in self.ids_of(t)]
        reach = self.spread(word, (_NONE, 0), len(word))[len(word)]
        goal = max(reach.items(), key=lambda x: (x[1][0], x[0]))[0]
        return [i for t in _walk(self, word, (_NONE, 0), len(word), goal) for i in self.ids_of(t)]

    def _weightless(self, word: str) -> list[str] | None:
        """The path of weight 0 through a word of a BPE model, long tokens first: no step can raise a weight over 0, so
        the first path that gets through is the optimum, and only states that lead nowhere are left and marked."""
        path, lost = [], set()

        def on(i: int, before: str) -> bool:
            if i == len(word):
                return True
            for t in reversed(self.tokens_at(word, i)):
                to = (i + len(t), t)
                if to in lost or self.weight(before, t) is None:
                    continue
                path.append(t)
                if on(i + len(t), t):
                    return True
                path.pop()
                lost.add(to)
            return False

        return path if on(0, _NONE) else None


class Merges:
    """BPE of many words at once: in each round every word makes its best merge, of equal ones the leftmost.

    A symbol is a piece's id or, for a character that is no piece, its code point behind all ids.
    """

    def __init__(self, model: Model) -> None:
        self.model, ids, score = model, model.ids, model.scores
        self.first = 1 + max(ids.values())
        self.n = self.first + 0x110000
        self.char = np.arange(self.first, self.n, dtype=np.int64)
        for t, i in ids.items():
            if len(t) == 1:
                self.char[ord(t)] = i

        def symbol(t: str) -> int | None:
            return int(self.char[ord(t)]) if len(t) == 1 else ids.get(t)

        made = {a * self.n + b: t for t in ids for k in range(1, len(t)) if (a := symbol(t[:k])) is not None and (b := symbol(t[k:])) is not None}
        place = {x: i for i, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.pair = np.array(sorted(made), np.int64)
        self.to = np.array([ids[made[k]] for k in self.pair.tolist()], np.int64)
        self.rank = np.array([place[score[made[k]]] for k in self.pair.tolist()], np.int64)

    def _looked_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each merge; the rank is _NEVER where there is none."""
        key = np.where((a >= 0) & (b >= 0), a * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NEVER), self.to[at]

    def __call__(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words])
        symbols = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self.model.word_ids(words[i])
        chosen = np.flatnonzero(sizes <= SHORT)
        chosen = chosen[np.argsort(sizes[chosen], kind="stable")]
        for k in range(0, len(chosen), MERGED):  # words of about one length share a table
            own = chosen[k : k + MERGED]
            col = np.arange(sizes[own[-1]])
            part = np.where(col < sizes[own][:, None], symbols[np.minimum(starts[own][:, None] + col, len(symbols) - 1)], -1)
            done = self._merged(part)
            odd = (done >= self.first).any(1).tolist()
            for i, row, n, o in zip(own.tolist(), done.tolist(), (done >= 0).sum(1).tolist(), odd):
                out[i] = [y for x in row[:n] for y in ([x] if x < self.first else self.model.ids_of(chr(x - self.first)))] if o else row[:n]
        return out

    def _merged(self, part: np.ndarray) -> np.ndarray:
        """part: the symbols of a word a row, -1 behind its end; the symbols left when no merge is."""
        done, rows = part.copy(), np.arange(len(part))
        rank, to = self._looked_up(part[:, :-1], part[:, 1:])
        while rank.shape[1]:
            best = rank.argmin(1)
            left = np.flatnonzero(rank[np.arange(len(part)), best] != _NEVER)
            if len(left) < len(part):
                done[rows] = part
                part, rank, to, rows, best = part[left], rank[left], to[left], rows[left], best[left]
                if not len(left):
                    break
            k = np.arange(len(part))
            part[k, best], made = to[k, best], best[:, None] < np.arange(part.shape[1])
            for table, behind in ((part, -1), (rank, _NEVER), (to, 0)):
                cut = made[:, : table.shape[1] - 1]
                table[:, :-1] = np.where(cut, table[:, 1:], table[:, :-1])
                table[k, -1] = behind
            for side in (best - 1, best):  # the two pairs that the new piece is in
                at = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                c = side[at]
                rank[at, c], to[at, c] = self._looked_up(part[at, c], part[at, c + 1])
        return done


@lru_cache(2)
def model_of(proto: bytes, kind: str) -> Model:
    """One model with its caches for all tasks of a worker."""
    return Model(proto, kind)


def _cuts(model: Model, body: str, left: str) -> tuple[int, int] | None:
    """First and last place in body where a word begins: there every path has a border, and steps across it are free."""
    if not model.words_apart or model.kind != "bpe":
        return None
    text = left[-1:] + body
    off = len(text) - len(body)
    first = next((i for i in range(max(1, off), len(text)) if text[i] == SPACE and text[i - 1] != SPACE), None)
    if first is None:
        return None
    last = next(i for i in range(len(text) - 1, 0, -1) if text[i] == SPACE and text[i - 1] != SPACE)
    return first - off, last - off


def _reached(model: Model, body: str, right: str, start: State) -> dict[State, float]:
    """Weights of the states at the right border of body; state ends are relative to that border."""
    n, found = len(body), {}
    for e, states in model.spread(body + right, start, n).items():
        if e >= n:
            for (t, _), (w, _, _) in states.items():
                found[(t, e - n)] = max(w, found.get((t, e - n), -np.inf))
    return found


def transfer(model: Model, left: str, body: str, right: str) -> Matrix:
    """The matrix of a chunk; left and right are its neighbours' nearest characters, left empty at the start."""
    starts = model.states_at(left, body + right) if left else [(_NONE, 0)]
    cuts = _cuts(model, body, left)
    if cuts is None:
        return {s: to for s in starts if (to := _reached(model, body, right, s))}
    first, last = cuts
    ends = _reached(model, body[last:], right, (_NONE, 0))
    return {s: dict(ends) for s in starts if s[1] <= first and (s[1] == first or any(e == first for e in model.spread(body[:first], s, first)))}


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product; associative."""
    out: Matrix = {}
    for s, mid in a.items():
        row: dict[State, float] = {}
        for m, w in mid.items():
            for t, x in b.get(m, {}).items():
                if w + x > row.get(t, -np.inf):
                    row[t] = w + x
        if row:
            out[s] = row
    return out


def border_states(matrices: list[Matrix], start: State = (_NONE, 0), goal: State | None = None) -> list[State]:
    """The states on the best path from start (to goal, if given) at borders 0 .. n: products up a balanced tree, choices
    down it."""

    def build(i: int, j: int) -> tuple:
        if j - i == 1:
            return matrices[i], None, None
        k = (i + j) // 2
        one, two = build(i, k), build(k, j)
        return product(one[0], two[0]), one, two

    def choose(node: tuple, s: State, t: State) -> list[State]:
        if node[1] is None:
            return [t]
        mid = max((m for m in node[1][0][s] if t in node[2][0].get(m, {})), key=lambda m: (node[1][0][s][m] + node[2][0][m][t], m))
        return choose(node[1], s, mid) + choose(node[2], mid, t)

    root = build(0, len(matrices))
    last = goal or max(root[0][start].items(), key=lambda x: (x[1], x[0]))[0]
    return [start, *choose(root, start, last)]


def _walk(model: Model, text: str, start: State, stop: int, goal: State) -> list[str]:
    reach = model.spread(text, start, stop)
    at, tokens = goal, []
    while at != start:
        _, before, token = reach[at[1]][at]
        tokens.append(token)
        at = before
    return tokens[::-1]


def backtrace(model: Model, left: str, body: str, right: str, start: State, goal: State) -> list[int]:
    """Ids of the tokens that start in body, between two known states; goal's end is relative to the right border."""
    n = len(body)
    goal = (goal[0], goal[1] + n)
    cuts = _cuts(model, body, left)
    if cuts is None:
        return [i for t in _walk(model, body + right, start, n, goal) for i in model.ids_of(t)]
    first, last = cuts
    head: list[str] = []
    if start[1] < first:
        head_end = max(model.spread(body[:first], start, first)[first].items(), key=lambda x: (x[1][0], x[0]))[0]
        head = _walk(model, body[:first], start, first, head_end)
    middle = list(chain.from_iterable(model.ids_of_words(_WORDS.findall(body, first, last))))
    tail = _walk(model, body[last:] + right, (_NONE, 0), n - last, (goal[0], goal[1] - last))
    return [i for t in head for i in model.ids_of(t)] + middle + [i for t in tail for i in model.ids_of(t)]


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def _columns(keys, texts: list[str], ids: list[list[int]], back: list[str], with_ids: bool) -> pa.RecordBatch:
    cols = [
        keys,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([hashlib.sha256(_pack(x)).hexdigest() for x in ids], pa.string()),
        pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
    ]
    names = ["doc_id", "n_chars", "n_tokens", "ids_sha256", "round_trip"]
    if with_ids:
        cols.append(pa.array(ids, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names)


def _schema(with_ids: bool) -> str:
    return "doc_id long, n_chars long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids


def _encode_small(shared, kind: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value, kind)
        # Lists of ids take several times their texts' memory, so few texts are encoded at once.
        for batch in (b.slice(i, ENCODED_ROWS) for b in batches for i in range(0, max(b.num_rows, 1), ENCODED_ROWS)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = model.lib.encode(texts, num_threads=1) if texts else []
            yield _columns(batch.column("doc_id"), texts, ids, model.lib.decode(ids, num_threads=1) if ids else [], with_ids)

    return run


_CHUNKS = "key string, doc_id long, no int, before string, body string, after string"
_CHUNK_SCHEMA = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("no", pa.int32()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string())])


def _cut_batches(longest: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = SPACE + raw.replace(" ", SPACE)
                key = f"{doc_id} {hashlib.md5(raw.encode()).hexdigest()}"
                rows = [(key, doc_id, k, text[max(0, i - longest) : i], text[i : i + chunk], text[i + chunk : i + chunk + longest]) for k, i in enumerate(range(0, len(text), chunk))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK_SCHEMA)], schema=_CHUNK_SCHEMA)

    return run


def _matrix_batches(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value, kind)
        for batch in batches:
            found = [_packed(transfer(model, r["before"], r["body"], r["after"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), pa.array(found, pa.string())], ["key", "no", "matrix"])

    return run


def _packed(matrix: Matrix) -> str:
    return json.dumps([[list(s), [[*t, w] for t, w in to.items()]] for s, to in matrix.items()])


def _unpacked(said: str) -> Matrix:
    return {tuple(s): {(t, e): w for t, e, w in to} for s, to in json.loads(said)}


def _block_product(rows: pd.DataFrame) -> pd.DataFrame:
    """The product of the matrices of a block of chunks."""
    rows = rows.drop_duplicates("no").sort_values("no")  # a document in the table twice has its chunks twice
    return pd.DataFrame({"key": rows["key"].values[:1], "block": rows["block"].values[:1], "matrix": [_packed(reduce(product, map(_unpacked, rows["matrix"])))]})


def _block_ends(rows: pd.DataFrame) -> pd.DataFrame:
    """The states at both borders of every block of a document."""
    rows = rows.sort_values("block")
    states = border_states([_unpacked(m) for m in rows["matrix"]])
    return pd.DataFrame({"key": rows["key"].values, "block": rows["block"].values, "ends": [json.dumps([a, b]) for a, b in zip(states, states[1:])]})


def _chunk_ends(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The states at both borders of every chunk of a block, between those of the block."""
    rows = rows.drop_duplicates("no").sort_values("no")
    start, goal = (tuple(x) for x in json.loads(ends["ends"].iloc[0]))
    states = border_states([_unpacked(m) for m in rows["matrix"]], start, goal)
    return pd.DataFrame({"at": rows["key"].values, "nth": rows["no"].values, "ends": [json.dumps([a, b]) for a, b in zip(states, states[1:])]})


_PARTS = "key string, doc_id long, no int, n_chars int, whole boolean, packed binary"


def _trace_batches(shared, kind: str):
    """Ids of each chunk, packed, and whether they spell out the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value, kind)
        for batch in batches:
            packed, whole = [], []
            for r in batch.to_pylist():
                start, goal = (tuple(x) for x in json.loads(r["ends"]))
                ids = backtrace(model, r["before"], r["body"], r["after"], start, goal)
                packed.append(_pack(ids))
                span = (r["body"] + r["after"])[start[1] : len(r["body"]) + goal[1]]
                # A sign before the span keeps decode() from taking its first blank for the one before the text.
                whole.append(model.lib.decode([model.bytes[ord("x")], *ids]) == "x" + span.replace(SPACE, " "))
            n = pa.array([len(x) for x in batch.column("body").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "no")), n, pa.array(whole), pa.array(packed, pa.binary())], ["key", "doc_id", "no", "n_chars", "whole", "packed"])

    return run


def _join_batches(with_ids: bool):
    """Ids of the chunks of each document one after the other; a row for each time the document is in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, parts in zip(batch.column("doc_id").to_pylist(), batch.column("parts").to_pylist()):
                copies = sum(p["no"] == 0 for p in parts)
                parts = list({p["no"]: p for p in parts}.values())
                packed = b"".join(p["packed"] for p in parts)
                ids = np.frombuffer(packed, "<i4")
                cols = [[doc_id], [sum(p["n_chars"] for p in parts) - 1], [len(ids)], [hashlib.sha256(packed).hexdigest()], [all(p["whole"] for p in parts)]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                names = ["doc_id", "n_chars", "n_tokens", "ids_sha256", "round_trip"]
                if with_ids:
                    cols, kinds, names = [*cols, [ids.tolist()]], [*kinds, pa.list_(pa.int32())], [*names, "ids"]
                for _ in range(copies):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def encoded(docs: DataFrame, model_path: str = MODEL_PATH, kind: str = "bpe", chunk: int = CHUNK, fan: int = FAN, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, n_tokens, ids_sha256, round_trip and, if asked, ids.

    ids_sha256 is of the ids as little-endian 32-bit numbers; round_trip tells whether decoding gives the text back
    (it does not where a text itself holds the model's blank sign U+2581).  Null text counts as empty and has no ids;
    repeated rows are each returned; an empty table gives no rows.  Documents of at most `chunk` characters are one
    chunk and stay in the scan's task; the chunks of longer ones are dealt over the cluster.  The model file is read
    on the driver and its bytes are broadcast, so executors need no copy of it.  Chunks are written once; their matrices
    are multiplied in blocks of `fan`, then the blocks'; the chunks of one document meet again only as ids.  Unigram
    models always go through the scan.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:
        proto = f.read()
    shared = spark.sparkContext.broadcast(proto)
    longest = Model(proto, kind).longest
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = F.length("text") <= (chunk if kind == "bpe" else 0)
    small = rows.filter(whole).mapInArrow(_encode_small(shared, kind, with_ids), _schema(with_ids))
    chunks = saved(rows.filter(~whole).mapInArrow(_cut_batches(longest, chunk), _CHUNKS).repartition("key", "no"), "chunks")
    matrices = chunks.mapInArrow(_matrix_batches(shared, kind), "key string, no int, matrix string")
    matrices = saved(matrices.withColumn("block", F.floor(F.col("no") / fan).cast("int")), "matrices")
    blocks = matrices.groupBy("key", "block").applyInPandas(_block_product, "key string, block int, matrix string")
    tops = blocks.groupBy("key").applyInPandas(_block_ends, "key string, block int, ends string")
    ends = matrices.groupBy("key", "block").cogroup(tops.groupBy("key", "block")).applyInPandas(_chunk_ends, "at string, nth int, ends string")
    told = chunks.join(ends, (F.col("key") == F.col("at")) & (F.col("no") == F.col("nth")))
    parts = told.mapInArrow(_trace_batches(shared, kind), _PARTS)
    parts = parts.groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "n_chars", "whole", "packed"))).alias("parts"))
    joined = parts.mapInArrow(_join_batches(with_ids), _schema(with_ids))
    return small.unionByName(joined)


def _decode_batches(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value, kind)
        for batch in batches:
            texts = [model.lib.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decoded(tokens: DataFrame, model_path: str = MODEL_PATH, kind: str = "bpe") -> DataFrame:
    """tokens (doc_id, ids) -> doc_id, text.  Null ids decode to an empty text."""
    small_batches(tokens.sparkSession)
    with open(model_path, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())
    return tokens.select("doc_id", "ids").mapInArrow(_decode_batches(shared, kind), "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"), with_ids=False)
