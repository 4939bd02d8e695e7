"""The registered jobs against their SQL."""

import duckdb
import pytest

from jobs import queries
from tests.test_catalog import rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    con = duckdb.connect()
    for t in ("part", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns, kinds = [c[0] for c in cursor.description], dict(df.dtypes)
    assert sorted(columns) == sorted(df.columns)
    got = rows(df.columns, kinds, df.collect())
    assert got == rows(columns, kinds, cursor.fetchall()) and got
