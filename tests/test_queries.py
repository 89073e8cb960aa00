"""Every query of the core against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    got = sorted(tuple(map(repr, (r[c] for c in sorted(df.columns)))) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in cursor.fetchall())


def test_latest_total_counts_the_catalog(spark, tmp_path):
    """Unknown products (supplier 7) don't count, nor does a last day that has no others."""
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT p::BIGINT AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' || p AS p_type, 1.5::DOUBLE AS p_retailprice, 1 AS p_size FROM range(1, 4) r(p)")
    con.execute("CREATE TABLE lineitem AS SELECT k::BIGINT AS l_orderkey, k::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, 1::INTEGER AS l_linenumber, 7.0::DOUBLE AS l_quantity, 'R' AS l_returnflag, d::TIMESTAMP AS l_shipdate FROM (VALUES (1, 1, '2001-01-01'), (2, 2, '2001-01-01'), (3, 7, '2001-01-01'), (1, 7, '2001-01-02')) v(k, s, d)")
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    want = con.execute(catalog.oracle_sql()["latest_total"]).fetchall()
    assert want == [("2001-01-01", 2)]
    assert [tuple(r) for r in catalog.queries()["latest_total"](spark, str(tmp_path)).collect()] == want
