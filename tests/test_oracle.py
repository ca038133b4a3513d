"""Every query with a SQL twin gives the same rows as DuckDB on the same tables."""

import math

import duckdb
import pytest

from segquery.plans import registry, seg_queries, vec_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
assert seg_queries and vec_queries


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, con):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=str)
    if name not in registry.SQL:
        assert mine
        return
    rel = con.sql(registry.SQL[name])
    names = rel.columns
    assert sorted(names) == cols
    kinds = dict(zip(names, map(str, rel.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    assert mine == sorted([tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()], key=str)
