"""Every query with SQL against DuckDB."""

import duckdb
import pytest

from galeframe.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = QUERIES[name](spark, FOLDER)
    result = con.sql(SQL[name]).select(*[f'"{c}"' for c in df.columns])
    assert sorted(map(tuple, df.toLocalIterator()), key=str) == sorted(result.fetchall(), key=str)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "string": "VARCHAR", "double": "DOUBLE"}
    assert [kinds[t] for _, t in df.dtypes] == list(map(str, result.types))


def test_names_are_the_numbered_ones():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
