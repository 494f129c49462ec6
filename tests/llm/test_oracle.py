import duckdb
import pytest

from graphloom.llm import queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    want = sorted(rel.fetchall())
    assert sorted(tuple(r) for r in queries.queries()[name](spark, folder).select(*columns).collect()) == want
