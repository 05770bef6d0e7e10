"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from linepack.plans import corpus, evaluation, layout, tokens

PLANS = (corpus, layout, tokens, evaluation)
QUERIES = {k: f for p in PLANS for k, f in p.QUERIES.items()}
SQL = {k: s for p in PLANS for k, s in p.ORACLE_SQL.items()}
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("events", "documents", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(SQL[name])
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert sorted(kinds) == cols
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
