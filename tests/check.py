"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from galeframe.plans.registry import load_all
from galeframe.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) else (math.isnan(v), v)) for v in row)


def difference(spark, con, q, sf_dir) -> tuple[int, str | None]:
    """Row count and, if Spark and SQL disagree, how."""
    df = q.run(spark, sf_dir)
    cols = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*cols).collect()]
    if q.sql is None:
        return len(mine), None
    result = con.sql(q.oracle())
    theirs_cols = sorted(result.columns)
    if cols != theirs_cols:
        return len(mine), f"columns {cols} <> {theirs_cols}"
    types = dict(zip(result.columns, map(str, result.types)))
    for c, t in df.dtypes:
        if TYPES.get(t, t) != types[c]:
            return len(mine), f"type of {c}: {t} <> {types[c]}"
    order = [result.columns.index(c) for c in cols]
    theirs = [tuple(r[i] for i in order) for r in result.fetchall()]
    if len(mine) != len(theirs):
        return len(mine), f"rows {len(mine)} <> {len(theirs)}"
    mine.sort(key=_key)
    theirs.sort(key=_key)
    for a, b in zip(mine, theirs):
        if a != b:
            return len(mine), f"{cols}\n   spark  {a}\n   duckdb {b}"
    return len(mine), None


if __name__ == "__main__":
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, q in load_all().items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            n, problem = difference(spark, con, q, folder)
        except Exception as error:  # report and go on with the next query
            n, problem = -1, f"{type(error).__name__}: {str(error)[:900]}"
        note = "ok" if problem is None else "DIFFERENT"
        print(f"{note:9} {name:45} rows={n:<8} {time.time() - begin:5.1f}s {'' if q.sql else '(no sql)'}", flush=True)
        if problem:
            bad += 1
            print("   ", problem, flush=True)
    print("queries with differences:", bad)
