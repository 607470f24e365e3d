"""Every query against its SQL on DuckDB, over whole tables."""

import decimal

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import changelog, live, relational, surface

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = changelog.QUERIES | live.QUERIES | relational.QUERIES | surface.QUERIES
ORACLES = changelog.ORACLES | live.ORACLES | relational.ORACLES | surface.ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    return float(x) if isinstance(x, decimal.Decimal) else bytes(x).hex() if isinstance(x, bytes | bytearray) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    want = duck.sql(ORACLES[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert columns == sorted(want.columns)
    assert rows == sorted(repr([plain(r[n]) for n in at]) for r in want.fetchall())


def test_entry_points(spark, sf_dir):
    assert QUERIES.keys() == ORACLES.keys() and QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).count() > 0


def test_whole_queries_take_every_row(spark, sf_dir):
    get = lambda name: QUERIES[name](spark, sf_dir).collect()
    orders = {(r.o_orderkey % 5, r.o_orderkey // 5 + 1) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").collect()}
    ours = {(a, v) for a, v in orders if v % 7 not in (2, 3) and v % 40 < 31 and a != 4}
    theirs = {(a, v) for a, v in orders if v % 11 != 5}
    assert {(r.actor, r.version, r.contains) for r in get("contains_version")} == {(*x, x in ours) for x in orders}
    near = {(a, s, s + d) for a, s in ours for d in range(-4, 5) if (a, s + d) in theirs}
    pairs = {(a, s, t) for a, s, t in near if s <= t + t % 5 and t <= s + 4}
    assert sorted((r.actor, r.a_start, r.b_start) for r in get("range_overlap")) == sorted(pairs)
    served = {(r.actor, v) for r in get("serve_need") if r.kind == "changes" for v in range(r.v_start, r.v_end + 1)}
    assert served == {(a, v) for a, v in ours if v % 5 != 1}
    customers = {r.c_custkey: r.c_mktsegment for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}
    merged = {k: "MOVED" if k % 6 == 1 and k % 9 != 4 else x for k, x in customers.items() if k % 9 != 4 or k % 8 != 5}
    assert {r.c_custkey: r.c_mktsegment for r in get("upsert_merge")} == merged
