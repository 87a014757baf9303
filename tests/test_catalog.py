"""Every registered engine query against its SQL in DuckDB."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from mirrorlake.operators import multiset
from mirrorlake.plans import catalog

DATA = Path("/root/testdata/sf0.001")


def canon(rows):
    def one(x):
        if isinstance(x, float):
            return f"{x:.6f}"
        if isinstance(x, decimal.Decimal):
            return f"{float(x):.6f}"
        return x.isoformat() if isinstance(x, datetime.datetime) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry._engine()[0]))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name in catalog.ORACLE_SQL:
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]}) z").fetchall()
        assert canon(got) == canon(want)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["bucket", "rows", "digest"] and df.count() == catalog.BUCKETS


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_null_safe_match_takes_every_order(spark, con):
    assert catalog.QUERIES["null_safe_match_whole"](spark, str(DATA)).count() == con.execute("SELECT count(*) FROM orders").fetchone()[0]


def test_matched_counts_the_null_group_without_pairs(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "b")], "id long, k string")
    others = spark.createDataFrame([(7, None), (8, None), (9, None), (10, "a")], "id long, k string")
    got = {r.id: (r.matches, r.least, r.greatest) for r in multiset.matched(rows, others, ["k"], "id").collect()}
    assert got == {1: (3, 7, 9), 2: (3, 7, 9), 3: (1, 10, 10)}


def test_gate_and_eviction_reach_the_end_of_the_log(spark, con):
    gate = catalog.QUERIES["commit_gate_whole"](spark, str(DATA)).agg({"l_orderkey": "max"}).first()[0]
    assert 0.8 < gate / con.execute("SELECT max(o_orderkey) FROM orders").fetchone()[0] <= 0.9
    gone = [r.seq for r in catalog.QUERIES["retention_eviction_whole"](spark, str(DATA)).collect()]
    last = con.execute("SELECT max(event_id) FROM events").fetchone()[0]
    assert max(gone) > 0.4 * last and 0.3 * last < len(gone) < 0.9 * last
