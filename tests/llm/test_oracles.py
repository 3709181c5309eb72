"""The operators' queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from lodestream.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in found.description)
    place = [[d[0] for d in found.description].index(c) for c in columns]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[k] for k in place)) for r in found.fetchall())
