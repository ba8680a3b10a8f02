"""What the check of round 3 found: op6 scanned words of giant texts one by one, op8 took too much memory."""

import random

import pytest
from pyspark.sql import functions as F

from promptweave.llm import common, exact_dedup, sentencepieces


@pytest.fixture(scope="module")
def model():
    with open(sentencepieces.MODEL_PATH, "rb") as f:
        return sentencepieces.Model(f.read())


def test_words_side_by_side(model, monkeypatch):
    monkeypatch.setattr(sentencepieces, "MERGED", 7)
    rng = random.Random(9)
    parts = ["ing", "é", "中", "a", "aa", "re", "😀", "\n", "th", "\x00", "x" * 70]
    words = [sentencepieces.SPACE * rng.randint(1, 3) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    assert model.ids_of_words(words) == [model._word_ids(w) for w in words]


def test_chunks_of_plain_words_are_not_scanned(model):
    rng = random.Random(3)
    text = sentencepieces.SPACE + sentencepieces.SPACE.join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    scanned = []
    model.word_ids = lambda w: scanned.append(w) or model._word_ids(w)
    states = sentencepieces.border_states([sentencepieces.transfer(model, "", text, "")])
    assert sentencepieces.backtrace(model, "", text, "", *states) == model.lib.encode(text[1:])
    assert not scanned


def test_white_space_goes_without_a_pattern(spark):
    """op8: no text is copied to UTF-16 and back, and what is white space stays the same."""
    texts = ["", " ", "a b\tc\nd\x0be\x0cf\rg  h", "   é😀\x85\x1c\x1f x\x00 y", "\r\n" * 50 + "中 文", " ▁ "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select("text", exact_dedup.normalised(F.col("text")).alias("body"), F.regexp_replace("text", f"{common.SPACE_CLASS}+", "").alias("want"))
    assert all(r.body == r.want for r in found.collect())
    assert "regexp" not in found.select("body")._jdf.queryExecution().optimizedPlan().toString().lower()
