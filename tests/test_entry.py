"""The driver's contract: registered queries run, and agree with their SQL in a second engine."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from promptweave import queries as core

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = core.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    spark.catalog.clearCache()
    if name not in core.ORACLE_SQL:
        assert got
        return
    told = duck.sql(core.ORACLE_SQL[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(told.columns, map(str, told.types)))
    assert got == sorted(repr(tuple(r)) for r in told.select(", ".join(f'"{c}"' for c in cols)).fetchall())
