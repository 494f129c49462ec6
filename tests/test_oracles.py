"""Every query with a SQL oracle, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from graphloom.plans import catalog
from graphloom.plans.projection import TABLES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.6g}" if abs(f) < 1e15 else str(v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    rel = duck.execute(catalog.oracle_sql()[name])
    want = rows([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
