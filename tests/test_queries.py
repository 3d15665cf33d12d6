"""The driver's contract, and a few queries side by side with their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings sessions messages raw_lines usage_raw chunks cached_index model_prices".split()
SIDE_BY_SIDE = "chunk_lines hybrid_search signals savings turns ground_truth project_rollup stream_savings".split()

needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    assert {"p1_found", "p4_found"} <= set(queries)


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda v: repr(float(v)) if type(v).__name__ in ("float", "Decimal") else repr(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows), sorted(names)


@needs_data
@pytest.mark.parametrize("name", SIDE_BY_SIDE)
def test_side_by_side(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    found = con.execute(entry.oracle_sql()[name])
    rows = found.fetchall()
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rows, [c[0] for c in found.description])


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
