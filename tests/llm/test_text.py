import hashlib
import itertools
import random
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from helpers import EDGE, documents, same_as_sql, sentence
from pyspark.sql import functions as F

from promptweave.llm import decontamination, language_id, pii, sentencepieces, toxicity
from promptweave.llm.common import crc_bucket, crc_bucket_py


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_matcher_against_brute_force():
    rng = random.Random(3)
    for k in range(200):
        vocabulary = "abcdefgh"[: rng.randint(2, 8)] if k % 4 else "中文字かなท"
        blank = " " if k % 4 else ""  # every sign of a script without blanks is a word
        items = [(i, blank.join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))) for i in range(5)]
        text = blank.join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
        words = list(text.replace(" ", ""))
        got = {m[0]: m[1] for m in decontamination.Matcher(items).find(text)}
        want = {}
        for i, t in items:
            signs = list(t.replace(" ", ""))
            d = edit_distance(signs, words)
            if d <= len(signs) // 5:
                want[i] = d
        assert got == want


def test_short_and_unspaced_items():
    found = decontamination.Matcher([(1, "What is 2+2?"), (2, "請問台灣最高的山是哪一座"), (3, "Yes."), (4, "?!")]).find
    assert [m[0] for m in found("Question: what is 2 + 2 ? Four")] == [1]
    assert found("what is 2 or 2") == []
    assert [m[:2] for m in found("他說:請問台灣最高的山是哪座?我不知道")] == [(2, 1)]
    assert [m[0] for m in found("yes!")] == [3] and [m[:3] for m in found("well, yes, it is")] == [(3, 0, 1)]
    short = decontamination.Matcher([(1, "2+2"), (2, "Who am I"), (3, "四海为家")]).find
    assert [m[0] for m in short("so 2 + 2 it is; who am I, 他四海为家了")] == [1, 2, 3] and short("2 + 3, who are they, 四海一家") == []


def test_repeated_pieces_are_read_once():
    item = " ".join(["for"] * 30)
    began = time.process_time()
    assert decontamination.Matcher([(1, item)]).find("for " * 100_000)[0][:2] == (1, 0)
    assert time.process_time() - began < 5


def test_exact_hits_are_those_of_sql(spark, sf_dir):
    sf_dir = Path(sf_dir).parent / "sf0.01"
    said = "' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), ' ') || ' '"
    want = duckdb.sql(
        f"SELECT doc_id, item_id FROM (SELECT doc_id, {said} AS d FROM '{sf_dir}/documents.parquet'), (SELECT item_id, {said} AS i FROM '{sf_dir}/benchmark.parquet') WHERE contains(d, i)"
    ).fetchall()
    got = decontamination.op1_benchmark_decontamination(spark, str(sf_dir)).filter("distance = 0").select("doc_id", "item_id").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_leaks(spark):
    rng = random.Random(5)
    item = sentence(rng, 20)
    changed = item.split()
    changed[3] = changed[11] = "other"
    far = [w if i % 3 else "other" for i, w in enumerate(item.split())]
    rows = [*EDGE, (10, f"before it {item.upper()} and after"), (11, " ".join(changed)), (12, " ".join(far)), (13, sentence(rng, 50))]
    bench = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, None, 0), (4, "Two!", 0), (5, "", 0)], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id): r.distance for r in decontamination.leaks(documents(spark, rows), bench).collect()}
    assert found == {(10, 1): 0, (10, 2): 0, (11, 1): 2, (11, 2): 2}
    in_blocks = decontamination.leaks(documents(spark, rows), bench, block_chars=40)
    assert {(r.doc_id, r.item_id): r.distance for r in in_blocks.collect()} == found
    docs = documents(spark, rows)
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.leaks(docs.limit(0), bench).count() == 0


@pytest.fixture(scope="module")
def model():
    with open(sentencepieces.MODEL_PATH, "rb") as f:
        return sentencepieces.Model(f.read())


WORDS = ["the", "representation", "ing", "中文字", "ää", "😀", "   ", "includegraphics", "\n", "aaaa", "====", "Hello", "transformation", "x\ty", "éléphant", "1234"]


def in_chunks(model, text, size):
    text = sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE)
    parts = [(text[max(0, i - model.longest) : i], text[i : i + size], text[i + size : i + size + model.longest]) for i in range(0, len(text), size)]
    states = sentencepieces.border_states([sentencepieces.transfer(model, *p) for p in parts])
    return [i for p, a, b in zip(parts, states, states[1:]) for i in sentencepieces.backtrace(model, *p, a, b)]


def test_scan_equals_the_models_own_encoding(model):
    rng = random.Random(5)
    for k in range(400):
        text = rng.choice([" ", "", "  "]).join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))
        if k % 3 == 0:
            text = "".join(rng.choice("abet hn inro") for _ in range(rng.randint(1, 60)))
        size = rng.choice([1, 2, 3, 5, 8, 13, 40])
        assert in_chunks(model, text, size) == model.lib.encode(text), (text, size)


def test_states_at_a_border_matter(model):
    """Text without blanks, cut anywhere: matrices of several rows that differ, and the product chooses among them."""
    text = "includegraphicsrepresentationtransformation" * 3
    marked = sentencepieces.SPACE + text
    parts = [(marked[max(0, i - model.longest) : i], marked[i : i + 10], marked[i + 10 : i + 10 + model.longest]) for i in range(0, len(marked), 10)]
    matrices = [sentencepieces.transfer(model, *p) for p in parts]
    assert any(len({tuple(sorted(to)) for to in m.values()}) > 1 for m in matrices)
    states = sentencepieces.border_states(matrices)
    halves = [sentencepieces.border_states(matrices[:5], goal=states[5]), sentencepieces.border_states(matrices[5:], states[5], states[-1])]
    assert halves[0] + halves[1][1:] == states
    assert in_chunks(model, text, 10) == model.lib.encode(text)


def test_words_take_the_path_of_the_scan(model):
    rng = random.Random(4)
    for _ in range(300):
        word = sentencepieces.SPACE * rng.randint(1, 3) + "".join(rng.choice(["ing", "é", "中", "a", "re", "😀", "\n", "th"]) for _ in range(rng.randint(0, 9)))
        reach = model.spread(word, (sentencepieces._NONE, 0), len(word))[len(word)]
        goal = max(reach.items(), key=lambda x: (x[1][0], x[0]))[0]
        assert model._weightless(word) == sentencepieces._walk(model, word, (sentencepieces._NONE, 0), len(word), goal)


def test_scan_of_a_giant_text_does_not_ask_the_library(model):
    rng = random.Random(8)
    text = " ".join(rng.choice(WORDS) for _ in range(30_000))
    want = model.lib.encode(text)

    class Own(sentencepieces.Model):
        pass

    own = Own(model.lib.serialized_model_proto())
    own.lib = None
    assert in_chunks(own, text, 16_384) == want


def test_scan_of_a_unigram_model_is_viterbi(model):
    uni = sentencepieces.Model(model.lib.serialized_model_proto(), "unigram")
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice("abet hn inro") for _ in range(rng.randint(1, 40)))
        marked = sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE)
        best = [0.0] + [-1e18] * len(marked)
        for i in range(len(marked)):
            for t in uni.tokens_at(marked, i):
                best[i + len(t)] = max(best[i + len(t)], best[i] + uni.scores.get(t, uni.unknown_score))
        ids = in_chunks(uni, text, rng.choice([2, 5, 9]))
        assert sum(uni.scores[uni.lib.id_to_piece(i)] for i in ids) == pytest.approx(best[-1])


def test_product_is_associative(model):
    text = sentencepieces.SPACE + "representationofthe"
    parts = [(text[max(0, i - 16) : i], text[i : i + 5], text[i + 5 : i + 21]) for i in range(0, len(text), 5)]
    a, b, c, *_ = [sentencepieces.transfer(model, *p) for p in parts]
    assert sentencepieces.product(sentencepieces.product(a, b), c) == sentencepieces.product(a, sentencepieces.product(b, c))


def test_encoding_of_documents(spark, model):
    rows = [*EDGE, (20, "中文字 x" * 30), (20, "中文字 x" * 30), (None, "a giant one " * 20)]
    got = sentencepieces.encoded(documents(spark, rows), chunk=50, fan=3)
    seen = sorted((str(r.doc_id), r.n_chars, r.ids_sha256, tuple(r.ids), r.round_trip) for r in got.collect())
    want = []
    for d, t in rows:
        ids = model.lib.encode(t or "")
        want.append((str(d), len(t or ""), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), tuple(ids), "▁" not in (t or "")))
    assert seen == sorted(want)
    back = {r.doc_id: r.text for r in sentencepieces.decoded(got.filter("doc_id in (4, 20)")).collect()}
    assert back == {4: "one", 20: "中文字 x" * 30}
    assert sentencepieces.encoded(documents(spark, rows).limit(0)).count() == 0


def test_forward_backward_in_chunks():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 31, 32, 33, 100, 64, 5])
    e, a = rng.random((lengths.sum(), 3)), rng.random((3, 3))
    got, at = language_id.forward_backward(e, lengths, a), 0
    for n in lengths:
        x = e[at : at + n]
        alpha, beta = [(np.ones(3) / 3 @ a) * x[0]], [np.ones(3)]
        for t in range(1, n):
            alpha.append((alpha[-1] @ a) * x[t])
        for t in range(n - 1, 0, -1):
            beta.append(a @ (x[t] * beta[-1]))
        want = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def by_enumeration(e, a):
    """Posteriors of labels and of neighbours' labels, and their gradient's terms, by all ways to label the words."""
    n, k = e.shape
    one, two, total = np.zeros((n, k)), np.zeros((n - 1, k, k)), 0
    for path in itertools.product(range(k), repeat=n):
        w = a[:, path[0]].mean() * e[0, path[0]]
        for t in range(1, n):
            w *= a[path[t - 1], path[t]] * e[t, path[t]]
        total += w
        for t in range(n):
            one[t, path[t]] += w
        for t in range(n - 1):
            two[t, path[t], path[t + 1]] += w
    return one / total, two / total


def test_pair_posteriors_against_enumeration():
    rng = np.random.default_rng(4)
    e, a = rng.random((6, 3)) ** 3, rng.random((3, 3)) ** 3
    alpha, beta = language_id.Chain(e, np.array([6]), a).run()
    one, two = by_enumeration(e, a)
    assert np.allclose(language_id.posteriors(alpha, beta), one)
    assert np.allclose(language_id.pair_posteriors(alpha, beta, e, a, np.arange(5)), two)


def test_blocks_of_a_long_document_change_nothing():
    sample = [("en", "the cat and the dog".split())] * 40 + [("fr", "le chat et le chien".split())] * 40
    field = language_id.fit_field(sample)
    rng = random.Random(3)
    words = [w for _ in range(60) for w in rng.choice(["the cat and the dog", "le chat et le chien"]).split()] * 3
    whole = language_id.Labeller(field).short([words])[0]
    cut = language_id.Labeller(field, block=37).long(words)
    assert np.allclose(whole[0], cut[0]) and (whole[1] == cut[1]).all()
    texts = [words[:5], [], words, words[5:50]]
    for i, total, own in language_id.Labeller(field, block=50).labelled(texts):
        want = language_id.Labeller(field).short([texts[i]])[0]
        assert np.allclose(total, want[0]) and (own == want[1]).all()


def test_every_label_is_learned(spark):
    """More languages than a hundred, each with a word of its own."""
    rows = [(k * 10 + i, f"word{chr(97 + k % 26)}{chr(97 + k // 26)} xx", f"l{k:03d}") for k in range(260) for i in range(2)]
    docs = documents(spark, [(10_000 + d, t, lang) for d, t, lang in rows])
    assert language_id.bounded_per_label(docs, "lang", F.col("doc_id"), 300).select("lang").distinct().count() == 260
    assert language_id.bounded_per_label(docs, "lang", F.col("doc_id"), 1).count() < 400


def test_language_features_know_their_word():
    owners, found = language_id.features(["ab", "é", "ab"])
    assert list(np.sort(found[owners == 0])) == list(np.sort(found[owners == 2]))
    assert len(found[owners == 1]) == 2 + 1 + 2  # two pairs, one triple, one letter at both ends


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.op7_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (crc_bucket_py(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_languages_edge_rows(spark):
    rows = [(100 + i, "the cat and the dog " * 5, "en") for i in range(30)] + [(200 + i, "le chat et le chien " * 5, "fr") for i in range(30)]
    rows += [(d, t, None) for d, t in EDGE] + [(7, "123 ?! ½", None), (8, "THE CAT 12", None), (9, "le chien, et the dog le chat", None)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.languages(documents(spark, rows)).collect()]
    by_id = {d: p for d, p, _ in got}
    assert len(got) == len(rows)
    assert by_id[1] == by_id[2] == by_id[3] == by_id[7] == "und" and by_id[8] == "en" and by_id[9] == "fr"
    assert language_id.languages(documents(spark, rows).limit(0)).count() == 0
    unlabelled = language_id.languages(documents(spark, [(1, "abc"), (2, None)])).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in unlabelled)


def test_code_switching_is_labelled_by_word():
    sample = [("en", "the cat and the dog".split())] * 40 + [("fr", "le chat et le chien".split())] * 40
    field = language_id.fit_field(sample)
    words = "the dog and the cat le chien et le chat".split()
    p = language_id.forward_backward(field.emissions(words), np.array([len(words)]), np.exp(field.transitions))
    assert list(p.argmax(axis=1)) == [0] * 5 + [1] * 5


def test_runs_of_code_switched_documents(spark):
    """Held-out words: each half of a text is labelled with its language, and the document columns follow from the runs."""
    rng = random.Random(7)
    english, french = ["theing", "shing", "wason", "ingly", "andthe"], ["réeux", "éelle", "quement", "auxet", "leçon"]

    def words(stems, n):
        return " ".join(rng.choice(stems) + rng.choice(["", "a", "o", "re"]) for _ in range(n))

    rows = [(100 + i, words(english, 40), "en") for i in range(60)] + [(300 + i, words(french, 40), "fr") for i in range(60)]
    rows += [(1000 + i, words(english, 30) + ". " + words(french, 20), None) for i in range(20)]
    got = {r.doc_id: r for r in language_id.languages(documents(spark, rows)).collect()}
    right = 0
    for i in range(1000, 1020):
        labels = [r.lang for r in got[i].runs for _ in range(r.words)]
        assert len(labels) == 50 and [r.first for r in got[i].runs] == [sum(x.words for x in got[i].runs[:k]) for k in range(len(got[i].runs))]
        right += sum(a == b for a, b in zip(labels, ["en"] * 30 + ["fr"] * 20))
        assert got[i].lang_pred == "en" and 0.5 <= got[i].score <= 0.7
    assert right >= 0.97 * 1000


def xor_sample(n=1500):
    """Either of two terms tells, both or none does not: each alone is as frequent in either class."""
    rng = np.random.default_rng(0)
    labels, sample = [], []
    for _ in range(n):
        a, b = map(bool, rng.random(2) < 0.5)
        noise = (1000 + np.flatnonzero(rng.random(60) < 0.3)).tolist()
        sample.append(np.array([100] * a + [200] * b + noise, np.int32))
        labels.append(float(a != b))
    return sample, np.array(labels)


def test_machine_learns_what_only_pairs_tell():
    machine = toxicity.fit_machine(*xor_sample())

    def score(m, *present):
        return m.score(sorted(m.slots[h] for h in present if h in m.slots))

    def right(m):
        return min(score(m, 100), score(m, 200)) > 0.9 and max(score(m, 100, 200), score(m)) < 0.1

    assert right(machine)
    additive = toxicity.Machine(machine.slots, machine.bias, machine.weights, np.zeros_like(machine.factors))
    assert not right(additive)
    assert len(machine.slots) < 10  # the noise stays out


def test_machine_learns_a_rare_term():
    """Seen in seven rows of a thousand toxic ones, but nothing else explains them."""
    rng = np.random.default_rng(1)
    labels = np.repeat([1.0, 0.0], 1000)
    sample = []
    for i in range(2000):
        telling = [] if i >= 1000 else [7] if i < 7 else [5]
        sample.append(np.array(telling + (1000 + np.flatnonzero(rng.random(200) < 0.1)).tolist(), np.int32))
    machine = toxicity.fit_machine(sample, labels)
    assert machine.score([machine.slots[7]]) >= 0.7 > machine.score([])


@pytest.mark.parametrize(("insults", "each"), [(100, 15), (187, 8), (75, 20)])
def test_machine_learns_a_long_tail(insults, each):
    """Many insults of few rows each; the words around them stay out and texts without any stay clean."""
    rng = random.Random(11)
    neutral = ["n" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    bad = ["z" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(insults)]

    def text(insult=()):
        return " ".join([*rng.sample(neutral, 40), *insult])

    texts = [text([x]) for x in bad for _ in range(each)] + [text() for _ in range(insults * each)]
    labels = np.repeat([1.0, 0.0], insults * each)
    machine = toxicity.fit_machine([np.array(sorted(toxicity.terms_of(t)), np.int32) for t in texts], labels)
    score = toxicity.Scorer(machine).score
    assert sum(score(text([x])) >= 0.7 for x in bad) >= 0.9 * insults
    assert sum(score(text()) < 0.7 for _ in range(200)) >= 195


def brute_score(machine, text):
    """The machine's formula by a loop over all pairs of terms, the terms by their definition."""
    words = {w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()}
    found = {toxicity._hash(b"w ", w) for w in words}
    for n in range(3, 8):
        starts = [w[:n] for w in words if len(w) >= n]
        found |= {toxicity._hash(b"p ", x) for x in starts} | {toxicity._hash(b"q ", x) for x in starts if starts.count(x) > 1}
    at = sorted(machine.slots[h] for h in found if h in machine.slots)
    z = machine.bias + sum(machine.weights[i] for i in at) + sum(machine.factors[i] @ machine.factors[j] for i in at for j in at if i < j)
    return 1 / (1 + np.exp(-z))


def test_scores_against_brute_force():
    rng = random.Random(3)
    texts = [None, "", "12 ?!", *(sentence(rng, rng.randint(1, 60), "abc") for _ in range(80))]
    found = sorted(set().union(*map(toxicity.terms_of, texts)))
    draw = np.random.default_rng(2)
    machine = toxicity.Machine({h: i for i, h in enumerate(found[::2])}, -0.3, draw.normal(0, 0.2, len(found[::2])), draw.normal(0, 0.2, (len(found[::2]), 4)))
    scorer = toxicity.Scorer(machine)
    for text in texts * 2:
        assert scorer.score(text) == pytest.approx(brute_score(machine, text))
        assert scorer.score(text) == machine.score(sorted(machine.slots[h] for h in toxicity.terms_of(text) if h in machine.slots))


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i, sentence(rng, 30) + (" you moron" if bad else "")))
        labels.append((i, int(bad)))
    rows += [(1000 + d if d else d, t) for d, t in EDGE]
    table = spark.createDataFrame([*labels, (0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    docs = documents(spark, rows)  # has columns named score, toxicity and _pw_score
    got = toxicity.scored(docs, table, "own").collect()
    assert len(got) == len(rows) and all(0 <= r.own <= 1 for r in got)
    assert all((r.own >= 0.7) == (r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 6 == 0) for r in got)
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 100
    assert {r.own < 0.7 for r in toxicity.scored(docs, table.limit(0), "own").collect()} == {True}
    assert toxicity.scored(docs.limit(0), table, "own").count() == 0


def test_held_out_toxicity(spark, sf_dir):
    sf_dir = str(Path(sf_dir).parent / "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = toxicity.op9_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (crc_bucket_py(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_folds(spark):
    got = spark.range(50).select("id", crc_bucket(F.col("id"), 3).alias("b")).collect()
    assert all(r.b == crc_bucket_py(r.id, 3) for r in got)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    import re

    found = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [c for c in m.group() if c in "0123456789"]
            if name == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and pii.luhn("".join(digits))):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def test_pii_base_spans():
    rng = random.Random(2)
    for _ in range(6000):
        text = "".join(rng.choice(rng.choice(["0123456789", "a@.-+ ()", "0.1@+-"])) for _ in range(rng.randint(0, 40)))
        assert [x for x in pii.find_spans(text) if x[1] < 4] == brute_pii(text), text


def test_pii_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" + "." * 200_000, "AB12" + "A1B2 " * 60_000, "1." * 100_000, "GB12" * 80_000, ("GB82" + "A1B2" * 10 + "AB" + " ") * 8_000, "GB82 " * 60_000):
        began = time.process_time()
        pii.find_spans(text)
        assert time.process_time() - began < 5, text[:10]


def iban_of(country, rng, blanks):
    body = "".join(rng.choice("0123456789ABCXYZ") for _ in range(pii.IBAN_SIGNS[country] - 4))
    turned = "".join(str(int(c, 36)) for c in body + country + "00")
    code = f"{country}{98 - int(turned) % 97:02d}{body}"
    return " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if blanks else code


def brute_ibans(text):
    """Every stretch of the text: a country's number of signs, blanks where groups of four meet, sum of digits."""
    sign = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    found = []
    for i in range(len(text)):
        for j in range(i + 15, min(len(text), i + 44) + 1):
            part = text[i:j]
            code = part.replace(" ", "")
            if pii.IBAN_SIGNS.get(code[:2]) != len(code) or not set(code) <= sign or code != code.upper() or not code[2:4].isdigit():
                continue
            if part[0] == " " or part[-1] == " " or "  " in part or any(c == " " and len(part[:k].replace(" ", "")) % 4 for k, c in enumerate(part)):
                continue
            if text[i - 1 : i] in sign or text[j : j + 1] in sign:
                continue
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                found.append((i, 4, j))
    return found


def test_pii_ibans_against_brute_force():
    rng = random.Random(12)
    seen = 0
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            iban = iban_of(rng.choice(["GB", "NO", "MT", "DE", "BE"]), rng, rng.random() < 0.6)
            parts.append(iban if kind < 0.5 else iban[: rng.randint(2, len(iban))] if kind < 0.7 else rng.choice(["XX12 ABCD", "GB82", "é", "NOW", "12", "a"]))
        text = rng.choice([" ", "  ", "", "\n"]).join(parts)
        want = brute_ibans(text)
        assert [x for x in pii.find_spans(text) if x[1] == 4] == want, text
        seen += len(want)
    assert seen > 150
    hidden = "XX12 ABCD EFGH GB29 NWBK 6016 1331 9268 19"
    assert [x for x in pii.find_spans(hidden) if x[1] == 4] == [(15, 4, 42)]
    both = "GB29 NWBK 6016 1331 9268 19 GB82 WEST 1234 5698 7654 32"
    assert [x for x in pii.find_spans(both) if x[1] == 4] == [(0, 4, 27), (28, 4, 55)]


def test_pii_twin_on_planted_texts(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", "a@b.co b@c", "1.2.3.256 1.2.3.4.5", "+12 (34) 567-89 01x", "iban GB82 WEST 1234 5698 7654 32, " + iban_of("NO", rng, True) + " bank", "card 4111-1111 1111 1111 0 4111111111111111"]
    texts += ["".join(rng.choice(rng.choice(["0123456789", "a@.-+ ()", "0.1@+-", "GB82 "])) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [" ".join(iban_of(rng.choice(["GB", "NO"]), rng, rng.random() < 0.5) for _ in range(3)) for _ in range(20)]
    same_as_sql(spark, tmp_path, "op10_pii", texts)


def test_personal_data(spark):
    rows = [*EDGE, (10, "my card is 4111 1111 1111 1111, iban GB82 WEST 1234 5698 7654 32 NOW"), (11, "é x@y.org +1 (988) 555-2485; 10.0.0.256 10.0.0.1")]
    got = {r.doc_id: r for r in pii.personal_data(documents(spark, rows)).collect()}
    assert got[10].spans == "card:11:30,iban:37:64" and got[10].scores == "0.90,1.00"
    assert got[11].spans == "email:2:9,phone:10:27,ip:40:48"
    assert got[11].base_sha256 == hashlib.sha256(got[11].spans.encode()).hexdigest()
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(documents(spark, rows)).count() == len(rows)
    assert pii.personal_data(documents(spark, rows).limit(0)).count() == 0
