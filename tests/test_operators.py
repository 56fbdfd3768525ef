"""Operators on small tables, with values by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import crc_prefix, filter_positions, modulo_placement, ring_hash, sortable_float, sortable_int
from tidemark.operators import observability, placement
from tidemark.operators import versions as V


@pytest.fixture
def log(spark):
    rows = [("alice", 1, "1000", False), ("bob", 1, "500", False), ("alice", 2, "800", False), ("bob", 2, "700", False), ("alice", 3, "900", False), ("alice", 4, None, True)]
    return spark.createDataFrame(rows, "key string, commit_ts long, value string, is_deleted boolean")


def pairs(df):
    return {r.key: r.value for r in df.collect()}


def test_versions(spark, log):
    assert pairs(V.snapshot(log, 1)) == {"alice": "1000", "bob": "500"}
    assert pairs(V.snapshot(log, 3)) == {"alice": "900", "bob": "700"}
    assert pairs(V.snapshot(log, 4)) == {"bob": "700"} and pairs(V.snapshot(log, 0)) == {}
    assert V.vacuum(log, 4).count() == 2 and pairs(V.compact(log)) == {"bob": "700"}
    staged = spark.createDataFrame([("alice", "1234", False), ("bob", None, True)], "key string, value string, is_deleted boolean")
    assert pairs(V.overlay(log, staged, 2)) == {"alice": "1234"}
    assert [tuple(r) for r in V.conflicts(log, staged, 2).orderBy("key").collect()] == [("alice", 4)]


def test_replay_drops_what_was_not_committed(spark):
    rows = [(0, "BEGIN", None, None), (1, "SET", "a", "1"), (2, "SET", "b", "2"), (3, "COMMIT", None, None), (4, "SET", "x", "9"), (5, "BEGIN", None, None), (6, "SET", "c", "3"), (7, "BEGIN", None, None), (8, "SET", "d", "4"), (9, "COMMIT", None, None), (10, "BEGIN", None, None), (11, "DELETE", "a", None)]
    assert pairs(V.replay(spark.createDataFrame(rows, "seq long, op string, key string, val string"))) == {"a": "1", "b": "2", "x": "9", "d": "4"}


def test_percentile_rank(spark):
    df = spark.createDataFrame([("s", float(v)) for v in (1, 2, 3, 4)], "series string, v double")
    assert {r.p: r.value for r in observability.percentiles(df, "series", "v", [50, 99, 100]).collect()} == {50.0: 3.0, 99.0: 4.0, 100.0: 4.0}
    assert observability.percentiles(df.limit(0), "series", "v", [50]).count() == 0
    assert {(r.le, r.n) for r in observability.histogram(df, "series", "v", (1, 3)).collect()} == {(1.0, 1), (3.0, 2), (None, 1)}


def test_ring(spark):
    ring = placement.build_ring(spark, ["a", "b", "c"], 50)
    keys = spark.range(500).select(F.concat(F.lit("key:"), F.col("id")).alias("key"))
    more = placement.build_ring(spark, ["a", "b", "c", "d"], 50)
    moved = placement.moved(keys, ring, more).collect()
    assert moved and {r.to_node for r in moved} == {"d"}
    assert placement.assign(keys, ring).count() == 500
    reps = placement.replicas(ring, ["a", "b", "c"]).collect()
    own = {r.position: r.node for r in ring.collect()}
    assert len(reps) == 3 * len(own) and all(own[r.position] == r.node for r in reps if r["rank"] == 1)
    assert abs(sum(r.percent for r in placement.load(ring).collect()) - 100) < 1e-9


def test_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("alice",), ("bob",), ("",), ("é",)], "k string")
    for r in df.select("k", ring_hash("k").alias("h"), *[modulo_placement("k", n).alias(f"m{n}") for n in (3, 4, 7)]).collect():
        whole = int(hashlib.md5(r.k.encode()).hexdigest(), 16)
        assert (r.h, r.m3, r.m4, r.m7) == (whole % 2**32, whole % 3, whole % 4, whole % 7)
    ints = [-(2**63), -5, -1, 0, 3, 9, 10, 100, 2**63 - 1]
    codes = [r.c for r in spark.createDataFrame([(i,) for i in ints], "i long").select("i", sortable_int("i").alias("c")).orderBy("i").collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(ints)


def test_float_codes_and_filter_positions(spark):
    import random
    import struct
    import zlib

    r = random.Random(3)
    floats = [0.0, -0.0, 1.0, -1.0, float("inf"), float("-inf"), float("nan"), 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 0.1, 3.0, 8.0, 1e22, *[2.0**k for k in range(-1074, 1024, 37)]]
    floats += [struct.unpack(">d", struct.pack(">Q", r.getrandbits(64)))[0] for _ in range(2000)]
    floats = [f for f in floats if f == f] + [float("nan")]

    def code(f):
        bits = struct.unpack(">Q", struct.pack(">d", f))[0]
        return f"{bits ^ (2**64 - 1) if bits >> 63 else bits ^ 1 << 63:016x}"

    got = spark.createDataFrame([(i, f) for i, f in enumerate(floats)], "i int, f double").select("i", sortable_float("f").alias("c")).collect()
    assert {x.i: x.c for x in got} == {i: code(f) for i, f in enumerate(floats)}
    for crc in (0, 1, 0x9E3779B9, 0xFFFFFFFF):
        assert zlib.crc32(crc_prefix(crc)) == crc
    keys = spark.createDataFrame([("alice",), ("",), ("\u00e9",)], "k string").select("k", filter_positions("k").alias("p")).collect()
    assert all(x.p == [zlib.crc32(x.k.encode(), s * 0x9E3779B9 & 0xFFFFFFFF) % 10000 for s in range(3)] for x in keys)


def test_replay_over_ranges(spark, monkeypatch):
    """The same log in one range and in many gives the same rows, as a loop does; nothing is joined by a nested loop."""
    import random

    r, rows, state, held, open_ = random.Random(6), [], {}, {}, False
    for seq in range(400):
        op = r.choices(["BEGIN", "COMMIT", "SET", "DELETE"], [1, 1, 6, 2])[0]
        key = f"k{r.randint(0, 30)}"
        rows.append((seq * 3, op, None if op in ("BEGIN", "COMMIT") else key, str(seq) if op == "SET" else None))
        if op == "BEGIN":
            open_, held = True, {}
        elif op == "COMMIT":
            state.update(held)
            open_, held = False, {}
        elif open_:
            held[key] = str(seq) if op == "SET" else None
        else:
            state[key] = str(seq) if op == "SET" else None
    log = spark.createDataFrame(rows, "seq long, op string, key string, val string")
    want = {k: v for k, v in state.items() if v is not None}
    assert pairs(V.replay(log)) == want
    monkeypatch.setattr(V, "RANGE_ROWS", 23)
    out = V.replay(log)
    plan = out._jdf.queryExecution().toString()
    assert pairs(out) == want and "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert pairs(V.replay(log.limit(0))) == {}


def test_replay_reads_a_range_once(spark, monkeypatch):
    """No window shrinks from one row to the next, which would cost the square of a range."""
    from pyspark.sql import functions as F

    at, last = F.col("id") % 10, 49_990
    op = F.when(at == 0, "BEGIN").when((at == 9) & (F.col("id") < last), "COMMIT").when(F.col("id") % 7 == 0, "DELETE").otherwise("SET")
    log = spark.range(50_000).select(F.col("id").alias("seq"), op.alias("op"), (F.col("id") % 101).cast("string").alias("key"), F.col("id").cast("string").alias("val"))
    state = {str(i % 101): None if i % 7 == 0 else str(i) for i in range(last) if i % 10 not in (0, 9)}
    want = {k: v for k, v in state.items() if v is not None}
    for rows in (V.RANGE_ROWS, 9_000):
        monkeypatch.setattr(V, "RANGE_ROWS", rows)
        out = V.replay(log)
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
        assert pairs(out) == want


def test_sparse_index_over_ranges(spark, monkeypatch):
    import random

    keys = sorted({f"{random.Random(i).getrandbits(40):x}" for i in range(1000)})
    frame = spark.createDataFrame([(k, 1) for k in keys], "k string, _range int").repartition(5)
    want = [(k, i) for i, k in enumerate(keys) if i % 16 == 0]
    for rows in (V.RANGE_ROWS, 90):
        monkeypatch.setattr(V, "RANGE_ROWS", rows)
        out = V.sparse_index(frame, "k", 16)
        assert sorted(map(tuple, out.collect())) == want
    assert "SinglePartition" not in out._jdf.queryExecution().toString() and V.sparse_index(frame.limit(0), "k", 16).count() == 0


def test_ranks_of_wide_series(spark):
    import random

    r = random.Random(2)
    rows = [("a", r.lognormvariate(0, 5) * r.choice([-1, 1]), i) for i in range(900)] + [("b", 7.5, i) for i in range(50)] + [("c", float("inf"), 1), ("c", -0.0, 2), ("c", 5e-324, 3)]
    df = spark.createDataFrame(rows, "series string, v double, seq long")
    for newest in (None, ("seq", 100)):
        got = {(x.series, x.p): x.value for x in observability.percentiles(df, "series", "v", [0, 50, 99, 100], newest).collect()}
        for s in "abc":
            own = sorted(v for x, v, q in sorted(rows, key=lambda x: -x[2]) if x == s) if not newest else sorted([v for x, v, q in sorted(rows, key=lambda x: -x[2]) if x == s][:100])
            assert [got[s, float(p)] for p in (0, 50, 99, 100)] == [own[min(len(own) * p // 100, len(own) - 1)] for p in (0, 50, 99, 100)]


def test_locks_and_clock(spark):
    held = spark.createDataFrame([(1, "a", "S"), (2, "a", "S"), (1, "b", "S"), (3, "c", "X")], "txn long, key string, mode string")
    asked = [(1, "a", "S", True), (1, "a", "X", False), (9, "a", "S", True), (1, "b", "X", True), (2, "b", "X", False), (2, "b", "S", True), (3, "c", "X", True), (3, "c", "S", True), (4, "c", "S", False), (4, "d", "X", True)]
    got = V.locks(spark.createDataFrame([x[:3] for x in asked], "txn long, key string, mode string"), held).collect()
    assert sorted(map(tuple, got)) == sorted(asked)
    walls = [5, 3, 3, 10, 9, 10, 30, 1]
    last, want = 0, []
    for w in walls:
        last = w if w > last else last + 1
        want.append(last)
    events = spark.createDataFrame([("n", i, w) for i, w in enumerate(walls)], "node string, seq long, wall long")
    assert [x.hlc for x in V.hybrid_clock(events, "node", "seq", "wall").orderBy("seq").collect()] == want


def test_waterfall(spark):
    spans = spark.createDataFrame([("t", "a", 1000, 5000), ("t", "b", 2000, 3000), ("t", "c", 4990, 5000), ("u", "d", 7, 7)], "trace string, span string, start_us long, end_us long")
    got = {x.span: (x.offset_us, x.duration_us, x.bar) for x in observability.waterfall(observability.span_offsets(spans)).collect()}
    assert got == {"a": (0, 4000, "\u2588" * 40), "b": (1000, 1000, " " * 10 + "\u2588" * 10), "c": (3990, 10, " " * 39 + "\u2588"), "d": (0, 0, "\u2588")}
