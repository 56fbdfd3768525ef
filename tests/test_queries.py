"""Every registered query outside of the llm folder against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tidemark.plans import registry


def views(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        name, path = f.split(".")[0], f"{sf}/{f}"
        c.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = views(sf).execute(registry.SQL[name]).df()
    (a, x), (b, y) = rows(got), rows(want)
    assert a == b
    assert len(x) == len(y) and (x or sf.endswith("0.001"))
    assert x == y


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_crc_is_zlibs(spark, sf):
    import zlib

    for r in registry.QUERIES["crc_check"](spark, sf).collect():
        assert r.crc == zlib.crc32(r.c_name.encode())


def test_rate_limit_is_a_token_bucket(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) / 1e6 as at").orderBy("user_id", "at", "event_id").collect()
    want, state = {}, {}
    for r in rows:
        tokens, then = state.get(r.user_id, (10.0, r["at"]))
        tokens = min(10.0, tokens + max(0.0, r["at"] - then) * 0.0005)
        ok = tokens >= 1
        want[r.event_id] = (ok, round(tokens - ok, 6))
        state[r.user_id] = (tokens - ok, r["at"])
    got = {r.seq: (r.allowed, r.tokens) for r in registry.QUERIES["rate_limit"](spark, sf).collect()}
    assert got == want


def test_filters_reach_the_scan(spark, sf):
    for name, column in (("index_range_gt", "l_quantity"), ("index_eq", "l_quantity"), ("events_since", "event_id"), ("mvcc_snapshot", "event_id")):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert f"({column}," in plan.split("PushedFilters")[1], name


def test_topk_is_planned_as_top_k(spark, sf):
    assert "TakeOrderedAndProject" in registry.QUERIES["topk"](spark, sf)._jdf.queryExecution().toString()


def test_ring_matches_bisection(spark, sf):
    import bisect
    import hashlib

    from tidemark.plans.analytics import NODES, VNODES

    at = lambda s: int(hashlib.md5(s.encode()).hexdigest(), 16) % 2**32
    ring = dict((at(f"{n}:vnode:{i}"), n) for n in NODES for i in range(VNODES))
    places = sorted(ring)
    for r in registry.QUERIES["ring_assign"](spark, sf).collect():
        assert r.node == ring[places[bisect.bisect_right(places, at(r.key)) % len(places)]]
    assert at("alice") == 2812696124
