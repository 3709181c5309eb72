"""Every query of the catalogue against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from lodestream.plans.catalogue import ORACLES, QUERIES
from lodestream.session import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}")
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    if name not in ORACLES:
        return
    found = oracle.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    wanted = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in found.fetchall()), key=str)
    assert rows == wanted
