"""Every registered query with SQL against DuckDB on the same rows."""

import math
import os

import duckdb
import pytest

from dipscan import oracles, queries, run_queries, table_queries

ORACLES = oracles.ORACLES | table_queries.ORACLES | run_queries.ORACLES
QUERIES = queries.QUERIES | table_queries.QUERIES | run_queries.QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def plain(rows):
    fix = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(([fix(v) for v in r] for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})")
    want = found.fetchall()
    have = got.select(columns).collect()
    assert len(have) == len(want)
    assert plain(map(list, have)) == plain(map(list, want))
