"""Queries with a SQL twin against DuckDB, on the corpus and on odd rows."""

import random

import duckdb
import pytest

from segquery.llm import decontaminate, packing, queries

TABLES = ["documents", "benchmark", "conversations"]
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def same(df, rel):
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols and {c: KINDS[k] for c, k in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    theirs = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=str)
    assert mine == theirs
    return mine


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_corpus(name, spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert same(queries.QUERIES[name](spark, sf), con.sql(queries.SQL[name]))


def test_odd_rows(spark, odd, odd_rows, tmp_path):
    docs = odd.select("doc_id", "text")
    given = odd_rows[0][1].split()
    items = [(0, " ".join(given[40:70])), (1, " ".join(given[100:109])), (1, "short one"), (2, None), (3, ""), (None, " ".join(given[:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for t, d in (("documents", docs), ("benchmark", bench)):
        d.write.parquet(f"{tmp_path}/{t}")
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}/*.parquet'")
    found = same(decontaminate.contaminated(docs, bench), con.sql(queries.SQL["op5_decontamination"]))
    assert len(found) == 15 and sum(r[0] for r in found) == 4
    assert len(same(packing.packed(docs), con.sql(queries.SQL["op9_packing"]))) == 15


def test_boundaries_of_ties(spark):
    """Of equally good boundaries both sides take the same ones."""
    con = duckdb.connect()
    r = random.Random(3)
    for _ in range(30):
        lengths = [r.randrange(2, 40) for _ in range(r.randrange(1, 60))]
        con.sql("create or replace table documents as select i::bigint as doc_id, repeat('w ', n - 1) as text from (select unnest(range(len(l))) as i, unnest(l) as n from (select " + str(lengths) + " as l))")
        rel = con.sql(queries.SQL["op9_packing"])
        bounds = sorted({x[rel.columns.index("boundary")] for x in rel.fetchall()})
        hist = {x: lengths.count(x) for x in lengths}
        assert bounds == packing.optimal_boundaries(list(hist), list(hist.values()), packing.BUCKETS)[0]
