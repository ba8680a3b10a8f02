"""Spelling variants, chat formatting, ranked search: against brute force, SQL and edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import EDGE, documents, same_as_sql, sentence
from pyspark.sql import functions as F

from promptweave.llm import chat_formatting as C
from promptweave.llm import ranked_search as R
from promptweave.llm import spelling_variants as V

# Spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for d, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = "".join(c.lower() if c.isascii() else c for c in r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 199 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            counts[r] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, out = {}, []
    for w, n in words.items():
        around = sorted((-words[v], v) for v in words if near(v, w))
        top = around[0] if around and -around[0][0] >= 5 * n else None
        forms[w] = top[1] if top else None
        out.append([w, n, len(around), forms[w], -top[0] if top else None])
    for row in out:
        at = row[0]
        while forms[at]:
            at = forms[at]
        row.append(at)
    return sorted(map(str, map(tuple, out)))


def spelled(rng, n):
    """Words at one and two edits around a few stems, the stems far more often."""
    stems = ["lighthouse", "harbour", "écluses", "ÿÀéabc", "a" * 40, "winter"]
    out = []
    for _ in range(n):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "z" + w[i + 1 :]])
        out.append(rng.choice([w, w.upper(), w.capitalize()]))
    return " ".join(out)


def test_trie_finds_all_neighbours():
    rng = random.Random(0)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abà") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 40))})
        trie = V.Trie(words, list(range(1, len(words) + 1)))
        for w in [*words, "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))]:
            assert sorted(trie.near(w)) == [(v, i + 1) for i, v in enumerate(words) if near(v, w)]


def test_long_words_in_tries():
    long = "ab" * 100_000
    trie = V.Trie(sorted([long, long + "c", long[:-1], "x" + long]), [1, 2, 3, 4])
    assert len(list(trie.near(long))) == 3 and [n for _, n in trie.near(long[:5000] + "?" + long[5000:])] == [2]


def test_variants(spark):
    rng = random.Random(1)
    rows = [(i, spelled(rng, rng.randint(0, 120))) for i in range(60)] + [r for r in EDGE if r[0] != 5] + [(7, "lighthouse " * 50), (7, "lighthouse " * 50), (None, "harbours " * 6), (70, "chained " * 200 + "chaineds " * 30 + "chainedss " * 5)]
    got = V.variants(documents(spark, rows))
    assert sorted(map(str, (tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()))) == brute_variants(rows)
    assert any(r.form and r.root != r.form for r in got.collect())  # chains of forms are followed
    assert V.variants(documents(spark, rows).limit(0)).count() == 0
    assert V.variants(documents(spark, [(1, "short words here")])).count() == 0


def test_variants_over_many_tries(spark, monkeypatch):
    """Many shards and rounds of broadcast give what one gives."""
    rng = random.Random(2)
    rows = [(i, spelled(rng, 150)) for i in range(40)]
    words = V.vocabulary(documents(spark, rows)).cache()
    want = sorted(map(tuple, V.nearest(words).collect()))
    made = spark.createDataFrame([(x.word, x.n) for x in words.collect()], "word string, n long")
    shards = made.repartitionByRange(7, "word").sortWithinPartitions("word").mapInArrow(V._shard_batches, "trie binary")
    monkeypatch.setattr(V, "tries", lambda _: shards)
    monkeypatch.setattr(V, "ROUND_BYTES", 1)
    assert len(list(V._rounds(shards))) > 3 and sorted(map(tuple, V.nearest(words).collect())) == want


def test_variants_equal_their_sql(spark, tmp_path):
    rng = random.Random(3)
    same_as_sql(spark, tmp_path, "op11_spelling_variants", [None, "", "  ", *[spelled(rng, 200) for _ in range(60)], "École écoles " * 9])


# Chat formatting

WIDE = (
    "id long, messages array<struct<role:string,content:string,weight:int>>, conversations array<struct<from:string,value:string>>, contents array<struct<role:string,parts:array<struct<text:string>>>>,"
    " system string, prompt string, response string, completion string, instruction string, input string, output string, question string, answer string, layout string, _fp long, turns int, loss string"
)


def record(id, **fields):
    return {"id": id, **fields}


LAYOUTS = [
    (record(1, messages=[("system", "s", 1), ("user", "a", None), ("assistant", "b", 2)]), "messages", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    (record(2, conversations=[("human", "q"), ("gpt", "r"), ("tool", None)]), "conversations", [("user", "q"), ("assistant", "r"), ("tool", "")]),
    (record(3, contents=[("user", [("x",), ("y",)]), ("model", []), (None, None)]), "contents", [("user", "xy"), ("assistant", ""), ("", "")]),
    (record(4, prompt="p", response="r"), "prompt_response", [("user", "p"), ("assistant", "r")]),
    (record(5, prompt="p", response="", system=""), "prompt_response", [("system", ""), ("user", "p"), ("assistant", "")]),
    (record(6, prompt="p", completion="c", system="s"), "prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    (record(7, instruction="i", input="", output="o"), "instruction", [("user", "i"), ("assistant", "o")]),
    (record(8, instruction="i", input="n", output="o"), "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    (record(9, instruction="i", output="o"), "instruction", [("user", "i"), ("assistant", "o")]),
    (record(10, question="q", answer="a"), "question_answer", [("user", "q"), ("assistant", "a")]),
    (record(11, messages=[]), "messages", []),
    (record(12, messages=[("user", None, None)]), "messages", [("user", "")]),
    (record(13), None, None),
    (record(14, prompt="p"), None, None),
    (record(15, prompt="p", response="r", answer="x"), None, None),
]


def test_layouts_by_fingerprint(spark):
    rows = spark.createDataFrame([r for r, _, _ in LAYOUTS], WIDE)
    got = {r.id: r for r in C.canonical(rows).collect()}
    assert [(got[r["id"]].layout, None if got[r["id"]].turns is None else [tuple(t) for t in got[r["id"]].turns]) for r, _, _ in LAYOUTS] == [(n, t) for _, n, t in LAYOUTS]
    assert got[4].fingerprint != got[5].fingerprint and got[7].fingerprint == got[8].fingerprint != got[9].fingerprint
    odd = spark.createDataFrame([(1, "x", 5)], "id long, messages string, prompt int")
    assert C.formatted(C.canonical(odd)).select("layout", "formatted").first() == (None, "")


NASTY = ["", "\\", "\\\\n", "</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>", "<<|im_end|>|im_end|>", "<\\s>", "<s", "s>", "<</SYS>><<SYS>>", "[[INST]]", "\\<s>", "é中😀\n\r\n", "<|endoftext|>" * 3, " "]


def test_escaping_is_reversible(spark):
    rng = random.Random(4)
    texts = NASTY + ["".join(rng.choice([*NASTY, "<", "|", "s", ">", "[", "\\", "/", "INST", "]"]) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escaped(F.col("t")).alias("e")).withColumn("u", C.unescaped(F.col("e")))
    for r in rows.collect():
        assert r.u == r.t and not any(c in r.e for c in C.CONTROL)


def test_formatted_turns_are_read_back(spark):
    rng = random.Random(5)
    told = [[(rng.choice(["user", "assistant", "system", "assistant ", "[INST]", "", None]), rng.choice([*NASTY, None])) for _ in range(rng.randint(0, 9))] for _ in range(80)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "id long, turns array<struct<role:string,text:string>>")
    rows = C.formatted(rows).withColumns({"again": C.turns_read(F.col("formatted")), "trained": C.trained_texts(F.col("segments"), F.col("loss"))})
    for r in rows.collect():
        want = [(a or "", b or "") for a, b in told[r.id]]
        assert [tuple(t) for t in r.again] == want and r.trained == [b for a, b in want if a == "assistant"] and "".join(r.segments) == r.formatted


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, all string, kind int")


def test_conversations(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(NASTY)) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(100 + c, t, r, f"{c} {r}") for c in range(12) for t, r in enumerate(["user", "assistant"])] + [(200 + c, t, r, f"{c} {r}") for c in range(12) for t, r in enumerate(["system", "user", "assistant"])]
    rows += [(300, 0, "user", "same"), (300, 0, "user", "same"), (300, 0, "assistant", None), (301, 0, None, None), (302, None, "assistant", "long " * 200_000)]
    rows += [(303, i, "assistant" if i % 2 else "human", f"t{i}") for i in range(3000)]
    same_as_sql(spark, tmp_path, "op12_chat_formatting", [], [("conversations", chats(spark, rows))])
    made = {r["as"] for r in C.as_records(chats(spark, rows)).selectExpr("case when messages is not null then 'm' when conversations is not null then 'c' when contents is not null then 'p' when prompt is not null then 'r' else 'i' end as `as`").collect()}
    assert made == set("mcpri")  # every layout is met


def test_added_conversation_alone(spark, tmp_path):
    chats(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op12_chat_formatting(spark, str(tmp_path)).collect()
    text = "</s>[INST] ok [/INST]"
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(-1, 2, len(text))]
    assert got[0].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[0].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_chat_formatting_is_native(spark, tmp_path):
    chats(spark, [(1, 0, "user", "a")]).write.parquet(f"{tmp_path}/conversations.parquet")
    plan = C.op12_chat_formatting(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Ranked search


def brute_search(docs, items, k=10):
    def terms(t):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    held = [(d, Counter(x), len(x)) for d, t in docs if (x := terms(t))]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s:
                scored.append((-s, d is None, d, s))
        out += [(item, i, d, s) for i, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(map(str, out))


def test_sums_of_slices():
    rng = random.Random(7)
    for _ in range(100):
        n = rng.randint(1, 90)
        columns = [[rng.choice([0, 0, 1, rng.randrange(1 << 40)]) for _ in range(n)] for _ in range(rng.randint(1, 6))]
        total = []
        for c in columns:
            places = [i for i, v in enumerate(c) if v]
            total = R.added(total, R.slices(np.array(places, np.int64), np.array([c[i] for i in places], np.int64)))
        sums = [sum(x) for x in zip(*columns, strict=True)]
        assert [R.value_at(total, i) for i in range(n)] == sums
        for k in (1, 3, n, 2 * n):
            want = sorted(i for i in sorted(range(n), key=lambda i: (-sums[i], i))[:k] if sums[i])
            assert sorted(R.best_places(total, k)) == want


def test_ranked(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, sentence(rng, rng.randint(0, 60), "abcde")) for i in range(300)] + EDGE[:5] + [(600 + i, "tie tie me") for i in range(15)] + [(7, "tie tie me"), (7, "tie tie me"), (None, "tie tie me"), (8, "中文 a中文 é-É_x9 ~")]
    items = [(i, sentence(rng, 6, "abcde")) for i in range(12)] + [(20, "tie me tie"), (20, "tie me tie"), (20, "Tie"), (21, None), (22, " .,"), (23, "unseen"), (24, "中文 É x9"), (None, "one")]
    table = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, rank string")
    frame = documents(spark, docs)
    want = brute_search(docs, items)
    assert sorted(map(str, (tuple(r) for r in R.ranked(frame, table).collect()))) == want
    monkeypatch.setattr(R, "PASS_TERMS", 5)  # several passes give the same
    assert sorted(map(str, (tuple(r) for r in R.ranked(frame, table).collect()))) == want
    assert R.ranked(frame.limit(0), table).count() == R.ranked(frame, table.limit(0)).count() == 0
    assert dict(R.ranked(frame, table.limit(0)).dtypes) == dict(R.ranked(frame, table).dtypes)


def test_blocks_are_cut_anywhere():
    """Blocks of one document, of few and of many give the same best ones."""
    rng = random.Random(9)
    docs = [(i % 7, sentence(rng, rng.randint(1, 30), "abc")) for i in range(200)]
    terms = sorted(Counter(sentence(rng, 12, "abc").split()).items())
    n_docs, total = len(docs), sum(len(t.split()) for _, t in docs)
    df = Counter(t for _, text in docs for t in set(text.split()))
    weights = {t: R.weight(n_docs, df[t]) for t, _ in terms if df[t]}
    got = []
    for size in (1, 3, 50, 200):
        found = []
        for a in range(0, len(docs), size):
            filling = R._Filling()
            for d, text in docs[a : a + size]:
                n, counts = R.counted(text)
                filling.add(d, n, {t: c for t, c in counts.items() if t in weights})
            block = R.Block(filling.row(), weights, n_docs, total)
            sums = block.scores(terms)
            found += [(-R.value_at(sums, p), block.ids[p]) for p in R.best_places(sums, 10)]
        got.append(sorted(found)[:10])
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == 10


def test_ranked_search_equals_its_sql(spark, tmp_path):
    rng = random.Random(10)
    texts = [None, "", "...", *[sentence(rng, rng.randint(1, 80), "abcdef") for _ in range(150)], "É é ſ K", "x" * 5000]
    items = spark.createDataFrame([(i, sentence(rng, 9, "abcdef")) for i in range(20)] + [(50, "É é K"), (51, None)], "item_id long, text string")
    same_as_sql(spark, tmp_path, "op13_ranked_search", texts, [("benchmark", items)])


