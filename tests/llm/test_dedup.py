import hashlib
import random
import re

import pytest
import xxhash
from helpers import EDGE, documents, same_as_sql, sentence

from promptweave.llm import components, exact_dedup, simhash, substring_dedup


def roots_of(n, edges):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (7, 3), (9, 8), (4, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)]])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, *edges, (None, 1)], "a long, b long")
    got = {r.node: r.root for r in components.component_roots(df).collect()}
    want = roots_of(100, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm):
        group = [r for r, m in zip(rows, norm) if m == n]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out.append((d, keep, len(group), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_exact_groups(spark):
    rows = [*EDGE, (10, "a b"), (11, "ab"), (-7, "a  b"), (12, "a\tb "), *[(100 + i, "hot copy") for i in range(200)]]
    got = [tuple(r) for r in exact_dedup.exact_groups(documents(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_exact(rows)))


def test_exact_drop_keeps_columns(spark):
    docs = documents(spark, [(1, "x y"), (2, "xy"), (3, "z")])
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3}


def brute_marks(rows):
    out = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
        shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [" ".join(ws)] * bool(ws)
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def test_near_classes(spark):
    rng = random.Random(4)
    base = sentence(rng, 400).split()
    rows = [(i, " ".join(w if rng.random() > 0.01 else "changed" for w in base)) for i in range(60)]
    rows += [(i, sentence(rng, rng.randint(1, 30))) for i in range(60, 90)]
    rows += [(90, "É Ab"), (91, "É ab"), (92, None), (93, " "), (94, "")]
    marks = brute_marks(rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 4]
    want = {i: (marks[i], r) for i, r in enumerate(roots_of(len(rows), links))}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_classes(documents(spark, rows)).collect()}
    assert got == want


def test_near_classes_edge_rows(spark):
    got = simhash.near_classes(documents(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert [r.component_id for r in got if r.doc_id == 4] == [4, 4]


@pytest.mark.parametrize("piece", [3, 10, 4096])
def test_links_join_what_pairs_join(spark, piece):
    """A crowded shard is cut into pieces, and no link is lost."""
    rng = random.Random(piece)
    centre = rng.getrandbits(64)
    marks = sorted({centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 9))}) for _ in range(150)})
    signed = [(m - 2**64 if m >= 2**63 else m,) for m in marks]
    got = [(marks.index(r.a % 2**64), marks.index(r.b % 2**64)) for r in simhash.near_links(spark.createDataFrame(signed, "fp long"), piece=piece).collect()]
    assert all((marks[a] ^ marks[b]).bit_count() <= 4 for a, b in got)
    pairs = [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 4]
    assert roots_of(len(marks), got) == roots_of(len(marks), pairs)


def test_bk_tree():
    rng = random.Random(1)
    values = {rng.getrandbits(12) for _ in range(300)}
    tree = simhash.BKTree()
    assert tree.within(5, 3) == []
    for v in values:
        tree.add(v)
    for _ in range(50):
        x, r = rng.getrandbits(12), rng.randint(0, 5)
        assert sorted(tree.within(x, r)) == sorted(v for v in values if (v ^ x).bit_count() <= r)


def brute_repeats(rows, window):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    least = {}
    for (d, _), ws in zip(rows, words):
        for p in range(len(ws) - window + 1):
            g = tuple(ws[p : p + window])
            if d is not None:
                least[g] = min(d, least.get(g, d))
    out = []
    for (d, _), ws in zip(rows, words):
        gone = {p + k for p in range(len(ws) - window + 1) if d is not None and least[tuple(ws[p : p + window])] < d for k in range(window)}
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    rng = random.Random(seed)
    vocabulary = "abcd"[: 2 + seed]
    pieces = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(pieces) if rng.random() < 0.6 else rng.choice(vocabulary) for _ in range(rng.randint(0, 5)))) for i in rng.sample(range(-50, 1000), 40)]
    rows += [(2000, pieces[0]), (2000, pieces[0]), (None, pieces[0]), (2001, None)]
    got = [tuple(r) for r in substring_dedup.without_repeats(documents(spark, rows), window=8, kmer=3).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows, 8)))


def test_spans_hold_at_their_sources(spark):
    rng = random.Random(5)
    pieces = [sentence(rng, rng.randint(5, 40), "abc") for _ in range(8)]
    rows = [(i, "\t".join(rng.choice(pieces) for _ in range(6))) for i in range(40)]
    words = {d: t.split() for d, t in rows}
    spans = substring_dedup.repeated_spans(documents(spark, rows), window=10, kmer=4)
    found = substring_dedup.verifiable(spans, documents(spark, rows)).collect()
    assert found and len(found) == spans.count()
    for r in found:
        own = words[r.doc_id][r.s : r.e]
        assert r.source < r.doc_id and len(own) == r.e - r.s and own == words[r.source][r.t : r.t + len(own)]
        assert [bytes(x) for x in r.digests] == [hashlib.blake2b(" ".join(own).encode(), digest_size=16).digest()]


def test_colliding_hashes_remove_nothing_wrong(spark):
    """With hashes of six bits nearly all windows meet wrongly; the words at the source's coordinates tell."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, 30, "abcdefgh")) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    for bits in (4, 6, 64):
        got = {r.doc_id: r.n_removed for r in substring_dedup.without_repeats(documents(spark, rows), window=8, kmer=3, bits=bits).collect()}
        assert all(got[i] == 0 for i in range(30)) and all(got[100 + i] <= 30 for i in range(10))
    assert all(got[100 + i] == 30 for i in range(10))


def test_texts_under_one_id_are_judged_by_their_own_words(spark):
    rng = random.Random(2)
    a, b, c = (sentence(rng, 40, "abcdefgh") for _ in range(3))
    rows = [(1, a), (2, b), (7, a + " " + c), (7, c), (7, c + " " + b)]
    got = sorted(tuple(r) for r in substring_dedup.without_repeats(documents(spark, rows), window=8, kmer=3).select("doc_id", "n_words", "n_removed").collect())
    assert got == [(1, 40, 0), (2, 40, 0), (7, 40, 0), (7, 80, 40), (7, 80, 40)]


def test_texts_under_one_id_whose_repeats_meet(spark):
    """Places of two texts of one id that would join to one span of their source, but stand in different texts."""
    rng = random.Random(4)
    words = sentence(rng, 120, "abcdefgh").split()
    own = [sentence(rng, 60, "ijklmnop") for _ in range(2)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:60]) + " " + own[0]), (2, own[1] + " " + " ".join(words[60:]))]
    rows += [(3, "x y " + own[0]), (3, own[1] + " z"), (4, own[0] + " " + own[1])]
    got = sorted(tuple(r) for r in substring_dedup.without_repeats(documents(spark, rows), window=8, kmer=3).select("doc_id", "n_words", "n_removed").collect())
    assert got == sorted((d, len(t.split()), n) for (d, t), n in zip(rows, [0, 60, 60, 60, 60, 120], strict=True))


def test_repeats_twin_on_planted_texts(spark, tmp_path):
    rng = random.Random(6)
    pieces = [" ".join(rng.choice("abcd") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    texts = [None, "", *(rng.choice([" ", "\n", "\t "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(40))]
    same_as_sql(spark, tmp_path, "op2_substring_dedup", texts)


def test_exact_twin_on_planted_texts(spark, tmp_path):
    rng = random.Random(6)
    same_as_sql(spark, tmp_path, "op8_exact_dedup", [None, "", " ", *("".join(rng.choice("ab \n") for _ in range(rng.randint(0, 6))) for _ in range(200))])


def test_repeats_edge_rows(spark):
    got = [tuple(r) for r in substring_dedup.without_repeats(documents(spark, EDGE)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(EDGE, 50)))


def test_empty_tables(spark):
    docs = documents(spark, [(1, "x")]).limit(0)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert simhash.near_classes(docs).count() == 0
    assert substring_dedup.without_repeats(docs).count() == 0
