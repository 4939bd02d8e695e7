"""Every query with SQL against DuckDB on the smallest tables; all others must run and have a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from locushift import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v, is_double):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) + 0.0 if is_double else v


def rows(columns, kinds, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i], kinds[columns[i]] == "double") for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    kinds = dict(df.dtypes)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, kinds, df.collect()) == rows(columns, kinds, cursor.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "ord" and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(os.path.abspath(catalog.__file__))
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, n)) as f:
                    assert "llm" not in f.read(), n
