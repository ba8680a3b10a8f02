"""Fixtures shared by the operator tests."""

import random

import duckdb

from promptweave.llm.queries import ORACLE_SQL, QUERIES

#: Extra columns whose names the operators use inside.
CLASHING = "doc_id long, text string, lang string, source string, h string, body string, fp long, mark string, spans string, key string, _pw_score string, score double, at int, component_id long, toxicity double"
N_EXTRA = 10


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); with columns of clashing names."""
    full = [(*r, *([None] * (3 - len(r))), "s", "x", "x", 1, "x", "x", "x", "x", 0.5, 1, 1, 0.5) for r in rows]
    return spark.createDataFrame(full, CLASHING).repartition(3)


def sentence(rng: random.Random, n: int, words: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id here"), (5, "word " * 30_000), (6, "héé 中文字 😀 ▁ x")]


def same_as_sql(spark, folder, name, texts, more=()):
    """Whether a registered query equals its SQL twin on a table documents of these texts; more: (name, frame) of others."""
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    for other, frame in more:
        frame.write.mode("overwrite").parquet(f"{folder}/{other}.parquet")
    got = QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    con = duckdb.connect()
    for table in ("documents", *(o for o, _ in more)):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, want))
